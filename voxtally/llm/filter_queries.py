"""Queries of the URL, mixing, line and quality operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm import line_dedup, mixing, quality, url_filter
from voxtally.llm.common import table
from voxtally.llm.registry import query
from voxtally.session import cut_lineage

URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

OP2_SQL = """
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(h, s, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                      ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT p.page_id, max_by(r.h || r.s, length(r.h || r.s)) AS rule,
         max_by(r.v, length(r.h || r.s)) AS v
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.s)
  GROUP BY p.page_id),
l AS (SELECT host, path FROM p WHERE host || path <> '' GROUP BY host, path HAVING count(*) > 1)
SELECT p.page_id, p.host, p.path, fits.rule,
       coalesce(fits.v, CASE WHEN l.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       l.host IS NOT NULL AS listed
FROM p LEFT JOIN fits USING (page_id) LEFT JOIN l ON p.host = l.host AND p.path = l.path
"""


@query("op2_url_filter", OP2_SQL)
def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's url; addresses that several pages share are the list."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    address = F.concat(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")))
    listed = pages.groupBy(address.alias("key")).count().where("count > 1 AND key <> ''")
    return url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES), listed).drop("url")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS words FROM d GROUP BY source),
o AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
         1.5 * sum(words) OVER () AS total
  FROM s),
c AS (
  SELECT *,
         total - coalesce(sum(2.0 * words) OVER before, 0) AS words_left,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_left
  FROM o
  WINDOW before AS (ORDER BY words / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, w * words_left / w_left >= 2.0 * words AS stops FROM c),
level AS (SELECT max_by(words_left, w_left) AS words_left, max(w_left) AS w_left FROM f WHERE NOT stops),
t AS (
  SELECT source, words, CASE WHEN stops THEN 2.0 * words ELSE w * level.words_left / level.w_left END AS target
  FROM f, level),
r AS (
  SELECT d.doc_id, d.size, t.words::BIGINT AS source_size, t.target::DOUBLE AS target,
         CASE WHEN t.words > 0 THEN t.target / t.words ELSE 0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""


@query("op3_mixing", OP3_SQL)
def mixed_sizes(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


OP5_SQL = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM l WHERE len(ls) >= 3),
x AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY ls[pos + 1:pos + 3] ORDER BY doc_id, pos) AS n
  FROM w WHERE regexp_matches(array_to_string(ls[pos + 1:pos + 3], ' '), '[^\x20\x09-\x0D]')),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM x, (SELECT unnest(range(0, 3)) AS k) WHERE n > 1),
each_line AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM l),
kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) AS text
  FROM each_line e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT l.doc_id, len(l.ls)::BIGINT AS n_lines, coalesce(n.n, 0)::BIGINT AS n_removed,
       length(coalesce(kept.text, ''))::BIGINT AS n_chars, md5(coalesce(kept.text, '')) AS text_md5
FROM l LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op5_line_dedup", OP5_SQL)
def repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.clean(table(spark, folder, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id", "n_lines", "n_removed",
        F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
w AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 2)) AS pos FROM d WHERE len(ws) >= 3),
c AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, ws[pos + 1:pos + 3]) AS n FROM w),
r AS (
  SELECT doc_id, count(DISTINCT pos + k)::BIGINT AS n_repeat_words
  FROM c, (SELECT unnest(range(0, 3)) AS k) WHERE n > 1 GROUP BY doc_id),
f AS (
  SELECT doc_id, source, len(ls) AS n_lines, len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (
  SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR word_chars < 2 * n_words
         OR word_chars > 20 * n_words OR 100 * n_dup_lines > 30 * n_lines AS failed
  FROM g),
s AS (SELECT source, count(*) AS n, sum(failed::INT) AS k FROM h GROUP BY source),
m AS (SELECT sum(n) AS n, sum(k) / sum(n) AS mean, count(*) AS hosts FROM s),
v AS (
  SELECT m.n, m.mean, m.mean * (1 - m.mean) AS noise,
         sum(s.n * (s.k / s.n - m.mean) ** 2) / m.n - m.mean * (1 - m.mean) * m.hosts / m.n AS between_
  FROM s, m GROUP BY m.n, m.mean, m.hosts),
p AS (
  SELECT mean, CASE WHEN between_ > 0 THEN least(greatest(noise / between_ - 1, 2), 10000) ELSE 10000 END AS strength
  FROM v),
k AS (SELECT s.source, (s.k + p.mean * p.strength) / (s.n + p.strength) <= 0.5 AS host_kept FROM s, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_kept AS kept
FROM h JOIN k ON h.source IS NOT DISTINCT FROM k.source
"""


@query("op10_quality", OP10_SQL)
def quality_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "source")
    stats = cut_lineage(quality.rule_stats(documents).drop("text"))
    return quality.judge(stats).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )
