"""Exact order statistics that never order one group inside one task.

A group may hold any share of the rows, so its values are counted first (which also combines
on the map side) and the counts are stored. A group with more distinct values than one task
should order is cut into value ranges by a small mergeable sketch; the ranges that hold a
wanted rank are kept and cut again, until each holds few enough. The sketch decides how the
work is spread, never the answer: counts of the ranges passed over are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtally.session import cut_lineage

RANGES = 32
#: Distinct values of one group, or of one range of it, that a task may order.
BOUND = 500_000

Ranks = Mapping[str, Callable[[Column], Column]]


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which null keys meet null keys."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, same).drop(*[f"_r_{k}" for k in keys])


def _targets(ranks: Ranks) -> list[Column]:
    total = F.col("_total")
    return [part(rank(total)) for part in (F.floor, F.ceil) for rank in ranks.values()]


def _cut(live: DataFrame, keys: list[str], ranks: Ranks, ranges: int) -> tuple[DataFrame, DataFrame]:
    """One round. ``live`` has _v, _n, the group's _total, _range and _start, the rank at which
    the range begins. Returns the rows of the narrower ranges that hold a wanted rank, and those
    ranges with _distinct, the number of their distinct values."""
    splits = [i / ranges for i in range(1, ranges)]
    shape = live.groupBy(*keys, "_range").agg(F.percentile_approx("_v", splits, F.lit(1000)).alias("_cuts"))
    # Plain comparisons stay in generated code; a lambda over the array would not.
    place = F.expr(" + ".join(
        f"CASE WHEN _v > get(_cuts, {i}) THEN 1 ELSE 0 END" for i in range(len(splits))))
    child = F.col("_range") * ranges + place + 1
    placed = _joined(live, shape, [*keys, "_range"]).select(
        *keys, "_v", "_n", "_total", F.col("_range").alias("_parent"), child.alias("_range"), "_start")

    # At most `ranges` rows per range that was cut reach this window.
    sizes = placed.groupBy(*keys, "_parent", "_range").agg(
        F.sum("_n").alias("_size"), F.count(F.lit(1)).alias("_distinct"),
        F.first("_total").alias("_total"), F.first("_start").alias("_start"))
    earlier = W.partitionBy(*keys, "_parent").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    begin = F.col("_start") + F.coalesce(F.sum("_size").over(earlier), F.lit(0))
    inside = [(t >= F.col("_start")) & (t < F.col("_start") + F.col("_size")) for t in _targets(ranks)]
    wanted = cut_lineage(
        sizes.withColumn("_start", begin).where(reduce(lambda a, b: a | b, inside))
        .select(*keys, "_range", "_start", "_distinct"))
    return _joined(placed.drop("_start", "_parent"), wanted, [*keys, "_range"]), wanted


def narrowed(freq: DataFrame, keys: Sequence[str], ranks: Ranks, *, bound: int, ranges: int) -> tuple[DataFrame, int]:
    """Counted values (_v, _n per key) of the ranges that hold the wanted ranks, with _total,
    _range and _start, and the number of rounds it took.

    No range has more than ``bound`` distinct values. Each round writes what it keeps and tells
    the driver one number, the size of the largest range.
    """
    keys, ranges = list(keys), max(ranges, 2)
    freq = cut_lineage(freq)
    of_groups = cut_lineage(freq.groupBy(*keys).agg(F.count(F.lit(1)).alias("_distinct"), F.sum("_n").alias("_total")))
    largest = of_groups.agg(F.max("_distinct")).first()[0] or 0
    start = {"_range": F.lit(0).cast("long"), "_start": F.lit(0).cast("long")}
    if largest <= bound:
        total = F.sum("_n").over(W.partitionBy(*keys))
        return freq.withColumns({"_total": total, **start}), 0
    live = _joined(freq, of_groups, keys).withColumns(start)
    done = [live.where(F.col("_distinct") <= bound)]
    live, rounds = live.where(F.col("_distinct") > bound), 0
    while largest > bound:
        kept, wanted = _cut(live, keys, ranks, ranges)
        kept, rounds = cut_lineage(kept), rounds + 1
        done.append(kept.where(F.col("_distinct") <= bound))
        live = kept.where(F.col("_distinct") > bound)
        largest = wanted.agg(F.max("_distinct")).first()[0]
    return reduce(DataFrame.unionByName, [d.drop("_distinct") for d in done]), rounds


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Ranks,
    *,
    bound: int = BOUND,
    ranges: int = RANGES,
) -> DataFrame:
    """One row per key with ``n`` and, per name, the value at a zero-based rank of ``n``.

    ``ranks`` maps an output name to a function of the group size. A fractional rank
    interpolates linearly between its two neighbours; towards infinity it is infinite, and
    never NaN. NULL values do not count; a NULL key is a key. The input is read once: counting
    its values runs when this is called.
    """
    keys = list(keys)
    if not keys:
        one = df.select(F.lit(0).alias("_all"), F.col(value))
        return order_statistics(one, ["_all"], value, ranks, bound=bound, ranges=ranges).drop("_all")

    freq = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    counted, _ = narrowed(freq, keys, ranks, bound=max(bound, 2 * ranges), ranges=ranges)
    within = W.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ordered = counted.withColumn("_end", F.col("_start") + F.sum("_n").over(within)) \
        .withColumn("_begin", F.col("_end") - F.col("_n"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_begin")) & (rank < F.col("_end")), F.col("_v")))

    total = F.col("_total")
    picked = ordered.groupBy(*keys).agg(
        F.first("_total").alias("_total"),
        *[at(F.floor(rank(total))).alias(f"_lo_{name}") for name, rank in ranks.items()],
        *[at(F.ceil(rank(total))).alias(f"_hi_{name}") for name, rank in ranks.items()],
    )
    out = []
    for name, rank in ranks.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        share = rank(total) - F.floor(rank(total))
        # Between two equal infinities, or from minus infinity on, there is no step to add.
        flat = (share == 0) | (lo == hi) | (lo == float("-inf"))
        out.append(F.when(flat, lo).otherwise(lo + (hi - lo) * share).alias(name))
    return picked.select(*keys, total.alias("n"), *out)


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], **options
) -> DataFrame:
    """Linear-interpolation percentiles per key, as ``{output name: probability}``."""

    def rank_of(p: float) -> Callable[[Column], Column]:
        return lambda n: F.lit(float(p)) * (n - 1)

    return order_statistics(
        df, keys, value, {name: rank_of(p) for name, p in probs.items()}, **options
    )
