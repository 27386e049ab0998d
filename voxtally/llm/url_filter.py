"""URL rules and block lists by a cascade of Bloom filters.

The first filter holds the listed keys. Every other key of the corpus that passes it goes
into the second filter, every listed key that passes the second goes into the third, and so
on until nothing passes wrongly. Because the cascade was closed over the complete key
universe of the corpus, its answer is exact for each of these keys, and testing needs neither
a join nor a shuffle: the filters travel as byte literals inside one projection.

A cascade takes at most ``max_listed`` keys, which bounds its bytes; a longer list is cut by
a hash of the key into several cascades that are tested one after another, so only one is
in flight at a time and no key is left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm.common import empty
from voxtally.session import cut_lineage

HASHES = 4
BITS_PER_KEY = 8
MAX_LISTED = 8_000_000  # 8 MB for the first filter, less for each later one
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Cascade = list[tuple[int, bytes]]  # per level: number of bits, the bits


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)([^?#]*)", 2)


def _position(key: Column, level: int, j: Column | int, bits: int) -> Column:
    j = F.lit(j) if isinstance(j, int) else j
    return F.pmod(F.xxhash64(key, F.lit(level), j), F.lit(bits))


def _passes(key: Column, level: int, bits: int, data: bytes) -> Column:
    """Whether all bits of the key are set."""
    literal, out = F.lit(data), F.lit(True)
    for j in range(HASHES):
        at = _position(key, level, j, bits)
        byte = F.conv(
            F.hex(F.substring(literal, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10
        ).cast("int")
        set_bit = F.expr("1").cast("int") * F.pow(F.lit(2), at % 8).cast("int")
        out = out & (byte.bitwiseAND(set_bit) != 0)
    return out


def member(key: Column, cascade: Cascade) -> Column:
    """Exact for every key of the universe the cascade was built over; null is no member."""
    out = F.lit(len(cascade) % 2 == 1)
    for level in range(len(cascade), 0, -1):
        out = F.when(_passes(key, level, *cascade[level - 1]), out).otherwise(
            F.lit(level % 2 == 0)
        )
    return F.when(key.isNull(), F.lit(False)).otherwise(out)


def _filter_bytes(keys: DataFrame, level: int, bits: int) -> bytes:
    """The filter over ``key``: bits are combined on the map side, then put in order."""
    spark = keys.sparkSession
    at = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.lit(HASHES - 1)),
            lambda j: _position(F.col("key"), level, j, bits),
        )
    ).alias("at")
    set_bits = keys.select(at).select(
        F.shiftright("at", 3).alias("byte"),
        F.pow(F.lit(2), F.col("at") % 8).cast("int").alias("bit"),
    )
    empty = spark.range(bits // 8).select(F.col("id").alias("byte"), F.lit(0).alias("bit"))
    bytes_ = set_bits.union(empty).groupBy("byte").agg(F.bit_or("bit").alias("bit"))
    row = bytes_.agg(
        F.unhex(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("byte", "bit"))),
                    lambda x: F.lpad(F.hex(x["bit"]), 2, "0"),
                ),
                "",
            )
        ).alias("data")
    ).first()
    return bytes(row["data"])


def build(keys: DataFrame, max_levels: int = 64) -> Cascade:
    """``keys``: ``key``, ``listed``, one row per key of the universe, staged by the caller.

    With nothing listed the cascade is empty and every key is unlisted. False positives
    shrink by a constant factor per level, so ``max_levels`` only guards against a key that
    is both listed and unlisted, which raises.
    """
    cascade: Cascade = []
    inside, outside = keys.where("listed"), keys.where("NOT listed")
    while n := inside.count():
        if len(cascade) == max_levels:
            raise ValueError("a key is both listed and unlisted")
        level = len(cascade) + 1
        bits = max(64, 8 * math.ceil(n * BITS_PER_KEY / 8))
        data = _filter_bytes(inside, level, bits)
        cascade.append((bits, data))
        inside, outside = outside.where(_passes(F.col("key"), level, bits, data)), inside
    return cascade


def cascades(universe: DataFrame, listed: DataFrame, max_listed: int = MAX_LISTED) -> list[Cascade]:
    """Cascades over ``key`` of both frames. No join: one grouping tells listed from the rest."""
    keys = cut_lineage(
        universe.select("key", F.lit(False).alias("listed"))
        .union(listed.select("key", F.lit(True).alias("listed")))
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.max("listed").alias("listed"))
    )
    n = keys.where("listed").count()
    parts = max(1, math.ceil(n / max_listed))
    return [build(keys.where(_part(F.col("key"), parts) == p)) for p in range(parts)]


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))


def _with_members(df: DataFrame, out: str, keys: Column, found: list[Cascade]) -> DataFrame:
    """``out``: the entries of the array ``keys`` that are listed."""
    if len(found) == 1:
        return df.withColumn(out, F.filter(keys, lambda k: member(k, found[0])))
    df = df.withColumn("__keys", keys).withColumn(out, F.slice("__keys", 1, 0))
    for p, cascade in enumerate(found):
        hit = F.filter(
            F.col("__keys"),
            lambda k: (_part(k, len(found)) == p) & member(k, cascade),  # noqa: B023
        )
        df = cut_lineage(df.withColumn(out, F.concat(out, hit)))
    return df.drop("__keys")


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every rule that could fit: host and parent domains with the path cut at rule lengths."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")
    )
    heads = F.filter(
        F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths]),
        lambda p: p.isNotNull(),
    ) if lengths else F.array().cast("array<string>")
    return F.flatten(
        F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.concat(s, p)))
    )


def judge(
    pages: DataFrame, rules: DataFrame, listed: DataFrame, *, max_listed: int = MAX_LISTED
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict``, ``listed``.

    ``rules`` (host, path, verdict ``allow`` or ``block``): a rule fits its host and all
    subdomains if the path starts with the rule's; the longest fitting rule decides, and of
    two rules with the same host and path ``block`` does. ``listed`` (key: host and path of
    an address): where no rule fits, a listed address is blocked and any other is allowed.

    A null or malformed url has an empty host and path, fits no rule and is allowed. Repeated
    rows are judged alike. Columns of the input named like an output are replaced. Either
    list may be empty.
    """
    pages = pages.withColumns({"__h": host_of(F.col("url")), "__p": path_of(F.col("url"))})
    kinds = cut_lineage(
        rules.where(F.col("host").isNotNull() & (F.col("host") != "") & F.col("path").isNotNull())
        .select(
            F.concat(F.translate("host", UPPER, LOWER), "path").alias("key"),
            F.length("path").alias("n"),
            (F.col("verdict") == "block").alias("block"),
        )
        .groupBy("key", "n")
        .agg(F.max("block").alias("block"))
    )
    # One row per distinct length of a rule's path: no more than a url has characters.
    lengths = [r["n"] for r in kinds.select("n").distinct().orderBy("n").collect()]
    fitting = candidates(F.col("__h"), F.col("__p"), lengths)
    address = F.concat("__h", "__p")

    rule_filter = cascades(pages.select(F.explode(fitting).alias("key")), kinds, max_listed)
    block_filter = cascades(kinds, kinds.where("block"), max_listed)
    list_filter = cascades(pages.select(address.alias("key")), listed, max_listed)

    out = _with_members(pages, "__rules", fitting, rule_filter)
    longest = F.get(
        F.array_sort(F.transform("__rules", lambda r: F.struct((-F.length(r)).alias("n"), r.alias("r")))),
        F.lit(0),
    )["r"]
    out = out.withColumn("__rule", longest)
    out = _with_members(out, "__blocks", F.array("__rule"), block_filter)
    out = _with_members(out, "__listed", F.array(address), list_filter)
    is_listed = F.size("__listed") > 0
    blocks = F.when(F.col("__rule").isNotNull(), F.size("__blocks") > 0).otherwise(is_listed)
    return out.withColumns({
        "host": F.col("__h"),
        "path": F.col("__p"),
        "rule": F.col("__rule"),
        "verdict": F.when(blocks, "block").otherwise("allow"),
        "listed": is_listed,
    }).drop("__h", "__p", "__rules", "__rule", "__blocks", "__listed")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (host, path, verdict)."""
    rows = [F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("host", "path", "verdict"))]) for r in rules]
    if not rows:
        return empty(spark, "host string, path string, verdict string")
    return spark.range(1).select(F.inline(F.array(*rows)))
