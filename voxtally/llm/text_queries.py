"""Queries of the language, personal-data and revisit operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm import language, pii, revisits, url_filter
from voxtally.llm.common import table
from voxtally.llm.registry import query


@query("op6_pii")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, pii.KINDS),
        F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )


@query("op1_language")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    """All pages by text, markup and address, and all documents by text and source."""
    documents, pages = table(spark, folder, "documents"), table(spark, folder, "pages")
    nothing = F.lit(None)
    rows = pages.select(
        F.col("page_id"), nothing.cast("bigint").alias("doc_id"), language.visible(F.col("html")).alias("text"),
        language.declared(F.col("html")).alias("declared"), url_filter.host_of(F.col("url")).alias("host"),
    ).union(documents.select(
        nothing.cast("bigint"), "doc_id", "text", nothing.cast("string"), "source"))
    found = language.identify(rows, language.fit(documents), ["page_id", "doc_id"])
    return found.withColumn("kept", F.col("confidence") >= 0.5)


# Each page is a response at time 2 * page_id; the crawler asks for it once more at an odd
# time, with the validators of its own copy: an entity tag, a weak one, a date only, or none.
OP7_SQL = r"""
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS size,
         ('0x' || substr(md5(coalesce(page_id::VARCHAR, '')), 1, 7))::BIGINT AS draw
  FROM pages),
c AS (
  SELECT *, regexp_replace(url, '#.*$', '') AS u FROM p),
k AS (
  SELECT *,
    CASE WHEN contains(u, '://') THEN
      regexp_replace(regexp_replace(lower(regexp_extract(u, '://([^/?]*)([^?]*)([?].*)?', 1)), '^www[.]', ''), ':(80|443)$', '')
      || regexp_replace(regexp_extract(u, '://([^/?]*)([^?]*)([?].*)?', 2), '/+$', '')
      || coalesce('?' || nullif(array_to_string(list_sort(list_filter(
           string_split(regexp_extract(u, '://([^/?]*)[^?]*[?](.*)', 2), '&'),
           lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]*|ref)(=|$)'))), '&'), ''), '')
    END AS key
  FROM c),
r AS (SELECT page_id, key, 2 * page_id AS asked_at, digest, size, '"' || substr(digest, 1, 16) || '"' AS etag,
             'day ' || (draw % 365)::VARCHAR AS modified FROM k WHERE key IS NOT NULL AND page_id IS NOT NULL),
v AS (SELECT page_id, key, 2 * page_id + 1 + 2 * (draw % 20011) AS asked_at,
             CASE draw % 4 WHEN 0 THEN '"' || substr(digest, 1, 16) || '"'
                           WHEN 1 THEN 'W/"' || substr(digest, 1, 16) || '"' END AS etag,
             CASE WHEN draw % 4 < 3 THEN 'day ' || (draw % 365)::VARCHAR END AS modified
      FROM k),
j AS (SELECT v.*, r.page_id AS response_id, r.digest, r.size, r.etag AS stored, r.modified AS stored_modified
      FROM v ASOF LEFT JOIN r ON v.key = r.key AND v.asked_at > r.asked_at),
s AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no response'
                 WHEN etag IS NOT NULL THEN CASE WHEN replace(etag, 'W/', '') = stored THEN 'resolved' ELSE 'validator mismatch' END
                 WHEN modified IS NULL THEN 'no validator'
                 WHEN modified = stored_modified THEN 'resolved' ELSE 'validator mismatch' END AS status
  FROM j)
SELECT page_id, key, asked_at, status, response_id,
       CASE WHEN status = 'resolved' THEN digest END AS digest,
       CASE WHEN status = 'resolved' THEN size::VARCHAR END AS content_length,
       CASE WHEN status = 'resolved' THEN asked_at::VARCHAR END AS date,
       CASE WHEN status = 'resolved' THEN coalesce(etag, stored) END AS etag
FROM s
"""


@query("op7_revisits", OP7_SQL)
def resolved_revisits(spark: SparkSession, folder: str) -> DataFrame:
    """Every page asked for once more; see the comment at the SQL for the captures."""
    html = F.coalesce("html", F.lit(""))
    pages = table(spark, folder, "pages").select(
        "page_id", "url", F.md5(html).alias("digest"), F.length(html).cast("string").alias("size"),
        F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 7), 16, 10)
        .cast("long").alias("draw"))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), (F.col("draw") % 365).cast("string"))
    kind = F.col("draw") % 4
    first = pages.select(
        F.col("page_id").alias("id"), "url", (2 * F.col("page_id")).alias("at"), F.lit(True).alias("full"),
        tag.alias("etag"), day.alias("last_modified"), "digest",
        F.create_map(F.lit("content-length"), F.col("size"), F.lit("etag"), tag,
                     F.lit("date"), (2 * F.col("page_id")).cast("string")).alias("headers"))
    asked = 2 * F.col("page_id") + 1 + 2 * (F.col("draw") % 20011)
    sent = F.when(kind == 0, tag).when(kind == 1, F.concat(F.lit("W/"), tag))
    again = pages.select(
        F.col("page_id").alias("id"), "url", asked.alias("at"), F.lit(False).alias("full"),
        sent.alias("etag"), F.when(kind < 3, day).alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("etag"), sent,
                     F.lit("date"), asked.cast("string")).alias("headers"))
    out = revisits.resolve(first.union(again))
    return out.select(
        F.col("id").alias("page_id"), "key", F.col("at").alias("asked_at"), "status", "response_id", "digest",
        F.element_at("headers", "content-length").alias("content_length"),
        F.element_at("headers", "date").alias("date"), F.element_at("headers", "etag").alias("etag"))
