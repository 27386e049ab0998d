"""Drawing and describing a stratified cohort."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtally.constants import ALLOCATION, ELIGIBLE, EXCLUDED_SPLIT, SPLIT_COLUMN
from voxtally.functions.text import subject_id_from_exam
from voxtally.operators.order_statistics import exact_percentiles, order_statistics
from voxtally.session import cut_lineage

COUNTED_FIELDS = ("Sex", "OS_tertile", "MGMT status", "EOR", "1-dead 0-alive", SPLIT_COLUMN)
DRAWN_FIELDS = ("Sex", "MGMT status", "EOR", "1-dead 0-alive", SPLIT_COLUMN)


def baseline_exams(metadata: DataFrame) -> DataFrame:
    """Rows of baseline exams with their ``subject_id``; follow-up exams drop out."""
    return metadata.withColumn("subject_id", subject_id_from_exam(F.col("ID"))).where(
        F.col("subject_id").isNotNull())


def available(exams: DataFrame, listing_ids: DataFrame) -> DataFrame:
    """Exams whose subject occurs in a listing."""
    return exams.join(listing_ids, "subject_id", "left_semi")


def eligible(exams: DataFrame, listing_ids: DataFrame) -> DataFrame:
    """The pool a cohort may be drawn from, with ``os_days`` as a number."""
    keep: Column = F.col("OS").rlike("^[0-9]+$")
    for column, wanted in ELIGIBLE.items():
        keep = keep & (F.trim(F.col(column)) == wanted)
    keep = keep & (F.trim(F.coalesce(F.col(SPLIT_COLUMN), F.lit(""))) != EXCLUDED_SPLIT)
    pool = exams.where(keep).withColumn("os_days", F.col("OS").try_cast("bigint"))
    return available(pool, listing_ids)


def survival_cuts(pool: DataFrame) -> DataFrame:
    """(t_low, t_high): the order statistics at one and two thirds of the pool."""
    return order_statistics(pool, [], "os_days", {
        "t_low": lambda n: F.floor(n / 3),
        "t_high": lambda n: F.floor(2 * n / 3),
    }).select(F.col("t_low").cast("bigint").alias("t_low"),
              F.col("t_high").cast("bigint").alias("t_high"),
              F.col("n").alias("n_pool"))


def survival_tertile(days: Column, low: Column, high: Column) -> Column:
    """``short`` up to the low cut, ``mid`` up to the high cut, else ``long``; cuts included."""
    return F.when(days <= low, "short").when(days <= high, "mid").otherwise("long")


def with_tertile(pool: DataFrame, cuts: DataFrame | tuple[float, float]) -> DataFrame:
    if isinstance(cuts, tuple):
        low, high = F.lit(cuts[0]), F.lit(cuts[1])
    else:
        low, high = cuts.select("t_low").scalar(), cuts.select("t_high").scalar()
    return pool.withColumn("OS_tertile", survival_tertile(F.col("os_days"), low, high))


def _allocation(df: DataFrame, allocation: Mapping[tuple[str, str], int]) -> DataFrame:
    rows = [(sex, tertile, k) for (sex, tertile), k in allocation.items()]
    return df.sparkSession.createDataFrame(rows, "Sex STRING, OS_tertile STRING, k BIGINT")


def allocation_cells(
    binned: DataFrame, allocation: Mapping[tuple[str, str], int] = ALLOCATION
) -> DataFrame:
    """Wanted, available and taken subjects per cell; ``short`` where a cell runs out."""
    have = binned.groupBy("Sex", "OS_tertile").agg(F.count(F.lit(1)).alias("n_available"))
    cells = _allocation(binned, allocation).join(have, ["Sex", "OS_tertile"], "left").na.fill(
        0, ["n_available"])
    return cells.withColumns({
        "n_taken": F.least("k", "n_available"),
        "short": F.col("n_available") < F.col("k"),
    })


def stratified_sample(
    binned: DataFrame,
    seed: int,
    allocation: Mapping[tuple[str, str], int] = ALLOCATION,
) -> DataFrame:
    """k subjects per (sex, tertile) without replacement, reproducible for a seed.

    The order is a hash of seed and id. The literal bound on the rank lets every map task
    keep only its own best rows of a cell, so a large cell never moves as a whole.
    """
    ticket = F.md5(F.concat(F.lit(str(seed)), F.col("subject_id")))
    order = W.partitionBy("Sex", "OS_tertile").orderBy("ticket", "subject_id")
    ranked = (
        binned.withColumn("ticket", ticket)
        .withColumn("draw", F.row_number().over(order))
        .where(F.col("draw") <= max(allocation.values()))
    )
    chosen = ranked.join(_allocation(binned, allocation), ["Sex", "OS_tertile"])
    return chosen.where(F.col("draw") <= F.col("k")).drop("ticket", "k").orderBy("subject_id")


def missing_ids(ids: DataFrame, exams: DataFrame) -> DataFrame:
    """Listed subjects without a metadata row."""
    return ids.select("subject_id").join(exams.select("subject_id"), "subject_id", "left_anti")


def join_cohort(ids: DataFrame, exams: DataFrame, declared_n: int | None = None) -> DataFrame:
    """Metadata of the listed subjects. A missing id, or a wrong length, aborts the job."""
    listed = ids.select("subject_id")
    marked = exams.withColumn("_found", F.lit(True))
    joined = listed.join(marked, "subject_id", "left")
    problem = F.when(F.col("_found").isNull(), F.concat(
        F.lit("cohort lists a subject absent from the metadata: "), F.col("subject_id")))
    if declared_n is not None:
        n = listed.agg(F.count(F.lit(1))).scalar()
        problem = F.coalesce(problem, F.when(n != declared_n, F.concat(
            F.lit(f"cohort declares n={declared_n} but lists "), n.cast("string"))))
    return joined.withColumn(
        "subject_id", F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.col("subject_id"))
    ).drop("_found")


def attribute_counts(rows: DataFrame, fields: tuple[str, ...] = DRAWN_FIELDS) -> DataFrame:
    """Rows per value of every field; a missing split counts as ``unused``."""
    long = rows.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"),
                 (F.coalesce(F.col(f), F.lit("unused")) if f == SPLIT_COLUMN else F.col(f)).alias("value"))
        for f in fields
    ])))
    return long.where(F.col("value").isNotNull()).groupBy("field", "value").agg(
        F.count(F.lit(1)).alias("n"))


def numeric_summary(rows: DataFrame) -> DataFrame:
    """Count, median, mean, minimum and maximum of age and survival."""
    long = cut_lineage(rows.select(F.inline(F.array(
        F.struct(F.lit("age_years").alias("field"),
                 F.col("Age at MRI").try_cast("double").alias("v")),
        F.struct(F.lit("os_days").alias("field"), F.col("OS").try_cast("double").alias("v")),
    ))))
    plain = long.groupBy("field").agg(
        F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    return exact_percentiles(long, ["field"], "v", {"median": 0.5}).join(plain, "field")
