"""Queries of the manifest, credential and whitening operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm import credentials, merkle, whitening
from voxtally.llm.common import table
from voxtally.llm.registry import query


OP11_SQL = """
WITH RECURSIVE
t AS (
  SELECT *, concat(
      coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS head,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, zero: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS checksum
  FROM documents),
h AS (
  SELECT doc_id, source, checksum, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(text) || ':' || translate(
           text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS lowered
  FROM t),
l AS (
  SELECT *, coalesce('1' || source, '0') AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n
  FROM h),
nodes AS (
  SELECT tree, 0 AS level, pos AS idx, n, leaf AS h FROM l
  UNION ALL
  SELECT tree, level + 1, idx // 16, max((n + 15) // 16), sha256(string_agg(h, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY tree, level + 1, idx // 16),
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS trees FROM nodes WHERE n = 1),
above AS (
  SELECT 0 AS level, place AS idx, trees AS n, h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, max((n + 15) // 16), sha256(string_agg(h, '' ORDER BY idx))
  FROM above WHERE n > 1 GROUP BY level + 1, idx // 16),
climb AS (
  SELECT tree, pos, 0 AS level, pos AS idx, n, CASE WHEN checksum % 5 = 0 THEN lowered ELSE leaf END AS h, '' AS proof FROM l
  UNION ALL
  SELECT c.tree, c.pos, c.level + 1, c.idx // 16, (c.n + 15) // 16,
         sha256(string_agg(CASE WHEN s.idx = c.idx THEN c.h ELSE s.h END, '' ORDER BY s.idx)),
         c.proof || coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx <> c.idx), '')
  FROM climb c JOIN nodes s ON s.tree = c.tree AND s.level = c.level AND s.idx // 16 = c.idx // 16
  WHERE c.n > 1 GROUP BY c.tree, c.pos, c.level, c.idx, c.n, c.h, c.proof),
over AS (
  SELECT c.tree, c.pos, 0 AS level, s.place AS idx, s.trees AS n, c.h, c.proof
  FROM climb c JOIN subroots s USING (tree) WHERE c.n = 1
  UNION ALL
  SELECT c.tree, c.pos, c.level + 1, c.idx // 16, (c.n + 15) // 16,
         sha256(string_agg(CASE WHEN s.idx = c.idx THEN c.h ELSE s.h END, '' ORDER BY s.idx)),
         c.proof || coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx <> c.idx), '')
  FROM over c JOIN above s ON s.level = c.level AND s.idx // 16 = c.idx // 16
  WHERE c.n > 1 GROUP BY c.tree, c.pos, c.level, c.idx, c.n, c.h, c.proof)
SELECT l.doc_id, l.leaf, subroots.h AS subroot, root.h AS root, sha256(over.proof) AS proof_sha256,
       over.h AS folded_root, over.h = root.h AS verified
FROM l JOIN subroots USING (tree) JOIN over USING (tree, pos), (SELECT h FROM above WHERE n = 1) root
WHERE over.n = 1
"""


@query("op11_manifest", OP11_SQL)
def manifest(spark: SparkSession, folder: str) -> DataFrame:
    leaves = merkle.document_leaves(table(spark, folder, "documents"))
    return merkle.manifest(leaves, "source", ["doc_id"], carried=["doc_id"])


@query("op13_whitening")
def whitened(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(vectors, "embedding")


def _matched(name: str, pattern: str, group: int = 0) -> str:
    """SQL for doc_id, start, end and the length of a group of every match of a pattern."""
    quoted = pattern.replace("'", "''")
    return f"""{name} AS (
  SELECT doc_id, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS b,
         length(hits[i]) AS size, length(measured[i]) AS part
  FROM (SELECT doc_id, string_split_regex(text, '{quoted}') AS pieces, regexp_extract_all(text, '{quoted}') AS hits,
               regexp_extract_all(text, '{quoted}', {group}) AS measured,
               unnest(range(1, len(regexp_extract_all(text, '{quoted}')) + 1)) AS i FROM d))"""


def _op12_sql() -> str:
    strong = [(f"s{i}", *row) for i, row in enumerate(credentials.STRONG)]
    weak = [(f"w{i}", *row) for i, row in enumerate(credentials.WEAK)]
    tables = [
        "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
        *[_matched(name, pattern, group) for name, _, pattern, group, _ in strong],
        *[_matched(name, pattern) for name, _, _, pattern in weak],
        _matched("breaks", credentials.BREAK),
        "base AS (" + " UNION ALL ".join(
            f"SELECT doc_id, b, b + size AS e, {rank} AS rank, '{kind}' AS kind FROM {name} WHERE part >= {least}"
            for rank, (name, kind, _, _, least) in enumerate(strong)) + ")",
        "loose AS (" + " UNION ALL ".join(
            f"SELECT doc_id, b, b + size AS e, '{role}' AS role, '{kind}' AS kind FROM {name}"
            for name, role, kind, _ in weak) + ")",
    ]
    return "WITH " + ",\n".join(tables) + f""",
clear AS (SELECT * FROM loose w WHERE NOT EXISTS (
  SELECT 1 FROM base s WHERE s.doc_id = w.doc_id AND w.b < s.e AND s.b < w.e)),
parts AS (
  SELECT *, (SELECT count(*) FROM breaks x WHERE x.doc_id = p.doc_id AND x.b + x.size <= p.b) AS scope
  FROM (SELECT doc_id, b, e, role, kind, true AS weak FROM clear
        UNION ALL
        SELECT doc_id, b, e, CASE kind WHEN 'access' THEN 'identifier' ELSE 'secret' END, kind, false FROM base) p),
added AS (
  SELECT DISTINCT p.doc_id, p.b, p.e, list_position(['assign', 'access', 'hex'], p.kind) - 1 AS rank, p.kind
  FROM parts p JOIN parts q ON q.doc_id = p.doc_id AND q.scope = p.scope AND q.role <> p.role AND abs(q.b - p.b) <= {credentials.REACH}
  WHERE p.weak AND p.kind <> '' AND (p.role <> 'identifier' OR q.role = 'secret')),
b AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, string_agg(concat_ws(':', kind, b, e), ',' ORDER BY b, rank) AS written
  FROM base GROUP BY doc_id),
s AS (
  SELECT doc_id, string_agg(concat_ws(':', kind, b, e), ',' ORDER BY b, rank, e) AS spans, count(*) FILTER (extra) AS n_added
  FROM (SELECT doc_id, b, e, rank, kind, false AS extra FROM base UNION ALL SELECT doc_id, b, e, rank, kind, true FROM added)
  GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(written, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_added, 0)::BIGINT AS n_added
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN s USING (doc_id)
"""


@query("op12_credentials", _op12_sql())
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = credentials.find(table(spark, folder, "documents").select("doc_id", "text"))
    counts = [
        F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
        for kind in credentials.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(credentials.written(F.col("base")), 256).alias("base_sha256"),
        credentials.written(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"))
