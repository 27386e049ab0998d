"""Region-by-compartment tables: the reduction from voxels to regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtally.constants import (
    COMPARTMENT_CODES,
    COMPARTMENTS,
    DISJOINT,
    PROBABILITY_CHANNELS,
)
from voxtally.functions.labels import disjoint_volumes, in_compartment


def _column(value: Column | float | str) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def _known(compartments: Sequence[str]) -> list[str]:
    unknown = [c for c in compartments if c not in COMPARTMENT_CODES]
    if unknown:
        raise ValueError(f"unknown compartments {unknown}; expected some of {COMPARTMENTS}")
    return list(compartments)


def _lut_keys(lut: DataFrame) -> list[str]:
    return ["subject_id", "label"] if "subject_id" in lut.columns else ["label"]


def subregion_masks(voxels: DataFrame, label: str = "label") -> DataFrame:
    """Add one boolean per nested compartment."""
    return voxels.withColumns(
        {c.lower(): in_compartment(F.col(label), c) for c in COMPARTMENTS}
    )


def parcel_burden(cells: DataFrame, lut: DataFrame, tumor: Column) -> DataFrame:
    """Share of every region that a single mask covers."""
    counts = cells.groupBy("subject_id", F.col("region").alias("label")).agg(
        F.count(F.lit(1)).alias("parcel_voxels"),
        F.count_if(tumor).alias("tumor_voxels"),
    )
    return counts.join(lut, _lut_keys(lut)).select(
        "subject_id", "label", "name", "parcel_voxels", "tumor_voxels",
        (100.0 * F.col("tumor_voxels") / F.col("parcel_voxels")).alias("pct_burden"),
    )


def region_matrix(
    cells: DataFrame,
    lut: DataFrame,
    *,
    label: str = "label",
    keys: Sequence[str] = ("subject_id",),
    voxel_mm3: Column | float | str = 1.0,
    compartments: Sequence[str] = COMPARTMENTS,
) -> DataFrame:
    """Coverage of every region by every compartment, zero-overlap rows included.

    ``compartment_voxels`` counts the whole volume, regions outside the lookup too, so it
    is summed before the lookup join. ``keys`` identify one volume. ``voxel_mm3`` may be a
    column of ``cells`` (by name or expression) that holds each volume's own voxel size.
    """
    names = _known(compartments)
    keys = list(keys)
    counts = cells.groupBy(*keys, F.col("region").alias("label")).agg(
        F.count(F.lit(1)).alias("parcel_voxels"),
        *[F.count_if(in_compartment(F.col(label), c)).alias(f"_{c}") for c in names],
        F.max(_column(voxel_mm3)).alias("_mm3"),
    )
    # One row per region is left: the per-volume total is a window over a few hundred rows.
    volume = W.partitionBy(*keys)
    totals = counts.withColumns({f"_all_{c}": F.sum(f"_{c}").over(volume) for c in names})
    named = totals.join(lut, _lut_keys(lut))
    long = named.select(
        *keys, "label", "name", "parcel_voxels", "_mm3",
        F.inline(
            F.array(*[
                F.struct(
                    F.lit(c).alias("compartment"),
                    F.col(f"_all_{c}").alias("compartment_voxels"),
                    F.col(f"_{c}").alias("overlap_voxels"),
                )
                for c in names
            ])
        ),
    )
    mm3 = F.col("_mm3")
    overlap = F.col("overlap_voxels")
    return long.select(
        *keys, "label", "name", "compartment", "parcel_voxels", "compartment_voxels",
        "overlap_voxels",
        (overlap * mm3).alias("overlap_volume_mm3"),
        (100.0 * overlap / F.col("parcel_voxels")).alias("pct_of_parcel"),
        F.try_divide(100.0 * overlap, F.col("compartment_voxels")).alias("pct_of_compartment"),
    )


def probabilistic_region_matrix(
    cells: DataFrame,
    lut: DataFrame,
    *,
    probabilities: str = "p",
    channels: Column | Sequence[str] = PROBABILITY_CHANNELS,
    voxel_mm3: Column | float | str = 1.0,
    compartments: Sequence[str] = COMPARTMENTS,
) -> DataFrame:
    """Mean and standard deviation of every overlap when voxels are independent draws.

    ``channels`` is the order of the probability array: a fixed list, or an array column
    when each volume's sidecar states its own.
    """
    names = _known(compartments)
    order = channels if isinstance(channels, Column) else F.array(*[F.lit(c) for c in channels])

    def p(compartment: str) -> Column:
        raw = F.get(probabilities, (F.array_position(order, compartment) - 1).cast("int"))
        return F.when(raw.between(0.0, 1.0), raw).otherwise(
            F.raise_error(F.concat(F.lit("probability outside [0, 1]: "),
                                   F.coalesce(raw.cast("string"), F.lit("missing channel"))))
        )

    counts = cells.groupBy("subject_id", F.col("region").alias("label")).agg(
        F.count(F.lit(1)).alias("parcel_voxels"),
        *[F.sum(p(c)).alias(f"_mean_{c}") for c in names],
        *[F.sqrt(F.sum(p(c) * (1.0 - p(c)))).alias(f"_std_{c}") for c in names],
        F.max(_column(voxel_mm3)).alias("_mm3"),
    )
    long = counts.join(lut, _lut_keys(lut)).select(
        "subject_id", "label", "name", "parcel_voxels", "_mm3",
        F.inline(
            F.array(*[
                F.struct(
                    F.lit(c).alias("compartment"),
                    F.col(f"_mean_{c}").alias("overlap_voxels_mean"),
                    F.col(f"_std_{c}").alias("overlap_voxels_std"),
                )
                for c in names
            ])
        ),
    )
    mm3 = F.col("_mm3")
    mean, std = F.col("overlap_voxels_mean"), F.col("overlap_voxels_std")
    return long.select(
        "subject_id", "label", "name", "compartment", "parcel_voxels",
        "overlap_voxels_mean", "overlap_voxels_std",
        (mean * mm3).alias("overlap_volume_mm3_mean"),
        (std * mm3).alias("overlap_volume_mm3_std"),
        (100.0 * mean / F.col("parcel_voxels")).alias("pct_of_parcel_mean"),
        (100.0 * std / F.col("parcel_voxels")).alias("pct_of_parcel_std"),
    )


def in_table_order(matrix: DataFrame) -> DataFrame:
    """Compartment, then coverage from high to low; the label breaks ties."""
    return matrix.orderBy("compartment", F.desc("pct_of_parcel"), "subject_id", "label")


def top_regions(matrix: DataFrame, k: int, *, by: str = "pct_of_parcel") -> DataFrame:
    """The first ``k`` regions of every (subject, compartment), with their rank."""
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    order = W.partitionBy("subject_id", "compartment").orderBy(F.desc(by), "label")
    return matrix.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def present_labels(cells: DataFrame, lut: DataFrame) -> DataFrame:
    """The part of the lookup whose labels occur in the subject's volume."""
    seen = cells.select("subject_id", F.col("region").alias("label")).distinct()
    return seen.join(lut, _lut_keys(lut)).select("subject_id", "label", "name")


def compartment_scheme(table: DataFrame, key: str = "subject_id") -> DataFrame:
    """``disjoint`` or ``nested`` per table, ``unexpected`` when neither set is complete."""
    known = sorted({*DISJOINT, *COMPARTMENTS})
    seen = table.groupBy(key).agg(
        *[F.bool_or(F.col("compartment") == c).alias(c) for c in known]
    )

    def complete(names: Sequence[str]) -> Column:
        out = F.lit(True)
        for name in names:
            out = out & F.col(name)
        return out

    return seen.select(
        key,
        F.when(complete(DISJOINT), "disjoint")
        .when(complete(COMPARTMENTS), "nested")
        .otherwise("unexpected")
        .alias("scheme"),
    )


def region_volumes_wide(
    table: DataFrame, *, keys: Sequence[str] = ("subject_id",), scheme: str = "nested"
) -> DataFrame:
    """Disjoint volumes per region *name*, without label 0 and without all-zero regions."""
    if scheme not in ("nested", "disjoint"):
        raise ValueError(f"unexpected compartment scheme {scheme!r}")
    names = list(COMPARTMENTS if scheme == "nested" else DISJOINT)
    wide = (
        table.where(F.col("label") != 0)
        .groupBy(*keys, "name")
        .pivot("compartment", names)
        .agg(F.sum("overlap_volume_mm3"))
        .na.fill(0.0, names)
    )
    if scheme == "nested":
        parts = disjoint_volumes(F.col("WT"), F.col("TC"), F.col("ET"))
        wide = wide.select(*keys, "name", *[parts[c].alias(c) for c in DISJOINT])
    total = F.col("NCR") + F.col("ED") + F.col("ET")
    return wide.withColumn("total_mm3", total).where(F.col("total_mm3") > 0)


def top_region_volumes(
    table: DataFrame, k: int, *, keys: Sequence[str] = ("subject_id",), scheme: str = "nested"
) -> DataFrame:
    """The ``k`` regions with the largest volume per subject, or overall when ``keys`` is empty."""
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    wide = region_volumes_wide(table, keys=keys, scheme=scheme)
    if not keys:
        return wide.orderBy(F.desc("total_mm3"), "name").limit(k)
    order = W.partitionBy(*keys).orderBy(F.desc("total_mm3"), "name")
    return wide.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def paired_top_regions(pred: DataFrame, ref: DataFrame, k: int) -> DataFrame:
    """Regions either side sees, ranked by the larger of the two totals, missing side zero."""
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    keys = ["subject_id", "name"]
    sides = []
    for tag, table in (("pred", pred), ("ref", ref)):
        wide = region_volumes_wide(table)
        sides.append(wide.select(
            *keys, *[F.col(c).alias(f"{c}_{tag}") for c in DISJOINT],
            F.col("total_mm3").alias(f"total_{tag}"),
        ))
    both = sides[0].join(sides[1], keys, "full")
    numbers = [c for c in both.columns if c not in keys]
    both = both.na.fill(0.0, numbers)
    top = F.greatest("total_pred", "total_ref")
    order = W.partitionBy("subject_id").orderBy(F.desc("rank_mm3"), "name")
    return (
        both.withColumn("rank_mm3", top)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )
