"""Queries of the near-copy, passage and leak operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxtally.llm import leaks, near_dedup, passages
from voxtally.llm.common import table
from voxtally.llm.registry import query

# Every pair of classes that share a shingle, and components by recursion.
OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [md5(array_to_string(words, ' '))]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: md5(array_to_string(words[i:i + 4], ' ')))) END AS shingles
  FROM w),
-- Equal sets are one class, which keeps the join of shingles small.
class AS (
  SELECT doc_id, len(shingles) AS n, min(doc_id) OVER (PARTITION BY list_sort(shingles)) AS rep
  FROM sets WHERE len(shingles) > 0),
grams AS MATERIALIZED (
  SELECT s.doc_id AS rep, len(s.shingles) AS n, unnest(s.shingles) AS g
  FROM sets s JOIN class c ON c.doc_id = s.doc_id AND c.rep = c.doc_id),
links AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b
  FROM grams a JOIN grams b ON a.g = b.g AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(k, r) AS (
  SELECT DISTINCT rep, rep FROM class
  UNION
  SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.k AND l.b > reach.r),
root AS (SELECT k, min(r) AS component FROM reach GROUP BY k)
SELECT s.doc_id, len(s.shingles) AS n_shingles, coalesce(root.component, s.doc_id) AS component_id,
       coalesce(root.component, s.doc_id) IS NOT DISTINCT FROM s.doc_id AS kept
FROM sets s LEFT JOIN class c USING (doc_id) LEFT JOIN root ON root.k = c.rep
"""


@query("op4_near_dedup", OP4_SQL)
def near_copy_components(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_copies(table(spark, folder, "documents").select("doc_id", "text"))


@query("op8_leaks")
def benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op9_passages")
def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(table(spark, folder, "documents"))
