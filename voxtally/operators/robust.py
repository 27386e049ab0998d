"""Robust summaries of metric cells: medians and quartiles that account for gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.constants import COMPARTMENTS, METRICS
from voxtally.functions.text import robust_cell
from voxtally.operators.order_statistics import exact_percentiles
from voxtally.session import cut_lineage

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def cell_summary(
    long: DataFrame,
    *,
    pairs: Sequence[str] | None = None,
    compartments: Sequence[str] = COMPARTMENTS,
    metrics: Sequence[str] = METRICS,
) -> DataFrame:
    """Median, quartiles and counts per (pair,) compartment and metric; no cell is dropped.

    Without ``pairs`` the summary pools everything in ``long`` as one pair.
    """
    keys = ["compartment", "metric"] if pairs is None else ["pair_id", "compartment", "metric"]
    long = cut_lineage(long.select(*keys, "value", "status"))
    grid = [(c, m) for c in compartments for m in metrics]
    if pairs is not None:
        grid = [(p, *cell) for p in pairs for cell in grid]
    domain = long.sparkSession.createDataFrame(grid, ", ".join(f"{k} STRING" for k in keys))
    counts = long.groupBy(*keys).agg(*[
        F.count_if(F.col("status") == s).alias(f"n_{name}")
        for s, name in (("ok", "used"), ("missing", "missing"), ("inf", "inf"))
    ])
    usable = long.where(F.col("status") == "ok")
    quartiles = exact_percentiles(usable, keys, "value", QUARTILES).drop("n")
    return (
        domain.join(counts, keys, "left")
        .join(quartiles, keys, "left")
        .na.fill(0, ["n_used", "n_missing", "n_inf"])
    )


def with_cell_text(summary: DataFrame) -> DataFrame:
    return summary.withColumn("cell", robust_cell(
        F.col("median"), F.col("q1"), F.col("q3"), F.col("n_used"), F.col("metric")))


def denominator_exceptions(summary: DataFrame, n_total: int | DataFrame) -> DataFrame:
    """Cells whose used count differs from the cohort size, with their printed note."""
    total = F.lit(n_total) if isinstance(n_total, int) else n_total.scalar()
    keys = [k for k in ("pair_id", "compartment", "metric") if k in summary.columns]
    note = F.concat(
        F.concat_ws("/", *keys), F.lit(": n="), F.col("n_used"), F.lit("/"), total,
        F.lit(" (missing="), F.col("n_missing"), F.lit(", inf="), F.col("n_inf"), F.lit(")"),
    )
    return summary.where(F.col("n_used") != total).select(*keys, note.alias("note"))


def denominator_note(summary: DataFrame, n_total: int | DataFrame) -> DataFrame:
    """All exceptions in one line, empty when there are none."""
    cells = denominator_exceptions(summary, n_total)
    return cells.agg(F.array_join(F.array_sort(F.collect_list("note")), "; ").alias("note"))


def metric_spread(wide: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Median, quartiles, minimum and maximum of each wide metric column."""
    long = wide.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in metrics
    ]))).where(F.col("value").isNotNull())
    long = cut_lineage(long)
    edges = long.groupBy("metric").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    return exact_percentiles(long, ["metric"], "value", QUARTILES).join(edges, "metric")


def audit_order(long: DataFrame) -> DataFrame:
    return long.orderBy("pair_id", "compartment", "metric", "subject_id")
