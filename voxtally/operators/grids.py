"""Volume headers: grid comparison, consistency and readiness; run timing and status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.constants import FOLLOW_UP_CHANNELS
from voxtally.functions.text import version_from_banner
from voxtally.operators.order_statistics import exact_percentiles
from voxtally.session import cut_lineage


# The states a run record may be in.
STATUSES = ("ok", "skipped", "missing_input", "error")


def _rounded(sizes: str, digits: int) -> Column:
    return F.transform(sizes, lambda v: F.bround(v, digits))


def grid_matches(headers: DataFrame, reference: Column, group: str = "patient_id") -> DataFrame:
    """Whether shape, voxel size (4 decimals) and axes equal the group's reference header."""
    same = ["shape", "voxel_size_mm", "axcodes"]
    tidy = headers.withColumn("voxel_size_mm", _rounded("voxel_size_mm", 4))
    base = tidy.where(reference).select(
        group, F.struct(*same).alias("_ref")).dropDuplicates([group])
    return tidy.join(base, group, "left").withColumn(
        "grid_matches_reference", F.coalesce(F.struct(*same) == F.col("_ref"), F.lit(False))
    ).drop("_ref")


def all_channels_match(matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    return matched.groupBy(*keys).agg(
        F.every("grid_matches_reference").alias("all_channels_match_ref_grid"))


def grid_consistency(
    headers: DataFrame, keys: Sequence[str] = ("channel",), expected: DataFrame | None = None
) -> DataFrame:
    """Distinct grids (voxel size at 3 decimals) per channel over all timepoints.

    ``expected`` lists the keys that should have volumes; those without any come out with
    no grid and the status ``NONE PRESENT``.
    """
    keys = list(keys)
    distinct = headers.groupBy(*keys, "shape", _rounded("voxel_size_mm", 3).alias("_size")).agg(
        F.count(F.lit(1)).alias("_n"))
    found = distinct.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_grids"), F.sum("_n").alias("n_volumes"))
    if expected is not None:
        found = found.join(expected.select(*keys).distinct(), keys, "full").fillna(
            0, ["n_grids", "n_volumes"])
    return found.withColumn(
        "status",
        F.when(F.col("n_grids") == 0, "NONE PRESENT").when(F.col("n_grids") == 1, "CONSISTENT")
        .otherwise("VARIES"))


def readiness(
    headers: DataFrame,
    comparator: str,
    keys: Sequence[str] = ("timepoint",),
    channels: Sequence[str] = FOLLOW_UP_CHANNELS,
) -> DataFrame:
    """Timepoints with every raw channel and the comparator present."""
    wanted = [*channels, comparator]
    have = [F.bool_or(F.col("channel") == c) for c in wanted]
    ready = have[0]
    for h in have[1:]:
        ready = ready & h
    return headers.groupBy(*keys).agg(F.coalesce(ready, F.lit(False)).alias("ready"))


def _lacks_regions() -> Column:
    return (F.col("status") == "missing_input") & F.coalesce(
        F.col("reason").contains("parcellation"), F.lit(False))


def run_exit_code(records: DataFrame, *, require_regions: bool = False) -> DataFrame:
    """One row over all sources: the codes of ``run_status`` for the run as a whole."""
    failed = F.col("status") == "error"
    if require_regions:
        failed = failed | _lacks_regions()
    return records.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("n_failed")
    ).withColumn("exit_code", F.when(F.col("n_failed") > 0, 1).otherwise(0))


def run_status(records: DataFrame, *, require_regions: bool = False) -> DataFrame:
    """Runs per status and source, and the exit code they add up to.

    ``records`` has source, status, reason and has_metrics. Errors fail a source. A missing
    region map fails it only when region maps are required; other missing input never does.
    """
    no_regions = _lacks_regions()
    counts = records.groupBy("source").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        F.count_if((F.col("status") == "ok") & ~F.col("has_metrics")).alias("ok_without_metrics"),
        F.count_if(no_regions).alias("missing_regions"),
        F.count(F.lit(1)).alias("n"),
    )
    failed = F.col("error") > 0
    if require_regions:
        failed = failed | (F.col("missing_regions") > 0)
    return counts.withColumn("exit_code", F.when(failed, 1).otherwise(0))


# ------------------------------------------------------------------ timing

def cold_and_warm(records: DataFrame) -> DataFrame:
    """Mark the earliest run of every stage ``cold`` and the rest ``warm``.

    The earliest run is an aggregate, so a stage is never sorted as a whole.
    """
    key = F.struct(F.coalesce("mtime", F.lit(0.0)).alias("m"), F.col("run_id").alias("r"))
    first = records.groupBy("stage").agg(F.min(key).alias("_first"))
    return records.join(first, "stage").withColumn(
        "phase", F.when(key == F.col("_first"), "cold").otherwise("warm")).drop("_first")


def stage_timings(
    records: DataFrame, expected: DataFrame | int, *, unsplit: Sequence[str] = ()
) -> DataFrame:
    """Quartiles, extremes and counts per stage and phase.

    ``expected`` is the cohort size: one cold run is expected, the rest should be warm. A
    stage named in ``unsplit`` has no cold start: all its runs are one phase ``all``, and the
    whole cohort is expected.
    """
    phases = cold_and_warm(records).withColumn(
        "phase", F.when(F.col("stage").isin(*unsplit), "all").otherwise(F.col("phase")))
    marked = cut_lineage(phases.select("stage", "phase", "elapsed_s"))
    keys = ["stage", "phase"]
    edges = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_used"), F.min("elapsed_s").alias("min"),
        F.max("elapsed_s").alias("max"))
    quartiles = exact_percentiles(
        marked, keys, "elapsed_s", {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n")
    total = F.lit(expected) if isinstance(expected, int) else expected.scalar()
    return edges.join(quartiles, keys).withColumn(
        "n_expected", F.when(F.col("phase") == "cold", F.lit(1).cast("bigint"))
        .when(F.col("phase") == "all", total.cast("bigint"))
        .otherwise(F.greatest(total.cast("bigint") - 1, F.lit(0).cast("bigint"))))


def stage_backends(records: DataFrame) -> DataFrame:
    """The version and device of a stage, when all its records agree on one."""
    only = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    return records.groupBy("stage").agg(
        version_from_banner(only("version")).alias("version"), only("device").alias("device"))
