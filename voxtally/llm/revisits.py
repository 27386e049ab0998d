"""Not-modified revisits of an archive, resolved to the response they confirm.

An as-of join by canonical address: each revisit meets the latest full response captured
before it. Captures are sorted by range over (address, time), so an address with any share
of the rows spreads over many ranges; within a range the last response is carried forward,
and what crosses a range border, one address per border at most, is carried in a table of
one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtally.session import cut_lineage

# Header fields a not-modified answer may renew (fixed values of the HTTP standard, lower case).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")

NO_RESPONSE, MISMATCH, UNCHECKED, RESOLVED = "no response", "validator mismatch", "no validator", "resolved"


def canonical(url: Column) -> Column:
    """Host and path that address one resource: no scheme, ``www.``, default port, fragment,
    tracking parameters or closing slash; the host lower-cased. Null without ``://``."""
    url = F.regexp_replace(url, "#.*$", "")
    host = F.lower(F.regexp_extract(url, "://([^/?]*)([^?]*)([?].*)?", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, "://([^/?]*)([^?]*)([?].*)?", 2), "/+$", "")
    kept = F.array_join(F.array_sort(F.filter(
        F.split(F.regexp_extract(url, "://([^/?]*)[^?]*[?](.*)", 2), "&"),
        lambda p: (p != "") & ~p.rlike("^(utm_[a-z]*|ref)(=|$)"),
    )), "&")
    full = F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, full)


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored header fields with those renewed that a not-modified answer may renew."""
    empty = F.create_map().cast("map<string,string>")
    stored, fresh = F.coalesce(stored, empty), F.coalesce(fresh, empty)
    renewed = F.map_filter(fresh, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    untouched = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(renewed), k))
    return F.map_concat(untouched, renewed)


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def last_responses(captures: DataFrame) -> DataFrame:
    """``captures`` (key, at, full, id and ``answer``) with ``found``: the answer of the
    latest row with ``full`` that has the key and an earlier time; ties go to the larger id."""
    ordered = captures.withColumn("__full", F.coalesce("full", F.lit(False)))
    # At one time revisits come first: a response answers later requests only.
    ranged = cut_lineage(
        ordered.repartitionByRange("key", "at", "__full", "id").withColumn("__range", F.spark_partition_id())
    )
    order = [F.col("at"), F.col("__full"), F.col("id")]
    so_far = Window.partitionBy("__range", "key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    answer = F.when(F.col("__full"), F.col("answer"))
    within = ranged.withColumn("__in", F.last(answer, ignorenulls=True).over(so_far))

    # Addresses in several ranges: at most one per border between ranges.
    parts = ranged.groupBy("__range", "key").agg(
        F.max_by("answer", F.when(F.col("__full"), F.struct("at", "id"))).alias("last"))
    spread = parts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    before = Window.partitionBy("key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut_lineage(
        parts.join(F.broadcast(cut_lineage(spread)), "key")
        .withColumn("__carried", F.last("last", ignorenulls=True).over(before))
        .select(F.col("__range").alias("__r"), F.col("key").alias("__k"), "__carried")
    )
    joined = within.join(
        F.broadcast(carried), (F.col("__range") == F.col("__r")) & (F.col("key") == F.col("__k")), "left")
    return joined.withColumn("found", F.coalesce("__in", "__carried")).drop(
        "__full", "__range", "__in", "__r", "__k", "__carried")


def resolve(captures: DataFrame) -> DataFrame:
    """One row per revisit: ``id``, ``key``, ``at``, ``status``, ``response_id``, ``digest``,
    ``headers``.

    ``captures``: ``id``, ``url``, ``at``, ``full`` (a whole response, else a not-modified
    revisit), ``etag``, ``last_modified``, ``digest``, ``headers`` (lower-case names). A
    revisit is ``resolved`` when its entity tag equals the response's (weakly), or, where
    either has none, its last-modified does; then it gets the response's digest and the
    merged headers. Without a validator on one side it is ``no validator`` and still names
    the response; other validators are a ``validator mismatch``.

    A revisit with a null or malformed url or null time has ``no response``; such responses
    answer none. Repeated revisits are resolved alike. Further columns are left out; an empty
    table gives an empty one.
    """
    rows = captures.select(
        "id", canonical(F.col("url")).alias("key"), "at", "full",
        F.struct("id", "etag", "last_modified", "digest", "headers").alias("answer"))
    usable = F.col("key").isNotNull() & F.col("at").isNotNull()
    found = last_responses(rows.where(usable)).where(~F.coalesce("full", F.lit(False)))
    lost = rows.where(~usable & ~F.coalesce("full", F.lit(False))).withColumn("found", F.lit(None).cast(
        rows.schema["answer"].dataType))
    both = found.select("id", "key", "at", "answer", "found").union(
        lost.select("id", "key", "at", "answer", "found"))
    a, f = F.col("answer"), F.col("found")
    by_tag = a["etag"].isNotNull() & f["etag"].isNotNull()
    by_date = a["last_modified"].isNotNull() & f["last_modified"].isNotNull()
    holds = F.when(by_tag, _weak(a["etag"]) == _weak(f["etag"])).when(
        by_date, a["last_modified"] == f["last_modified"])
    status = (
        F.when(f.isNull(), NO_RESPONSE).when(holds.isNull(), UNCHECKED).when(holds, RESOLVED).otherwise(MISMATCH)
    )
    resolved = status == RESOLVED
    return both.select(
        "id", "key", "at", status.alias("status"), f["id"].alias("response_id"),
        F.when(resolved, f["digest"]).alias("digest"),
        F.when(resolved, merged_headers(f["headers"], a["headers"])).alias("headers"),
    )
