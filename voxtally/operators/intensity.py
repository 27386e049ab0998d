"""Intensity volumes: normalisation, boxes, correlation and brain coverage.

Statistics are aggregated per volume and joined back, so voxels are never gathered by
volume. The statistics are counted first and broadcast only up to a bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.functions.columns import by_shuffle
from voxtally.operators.order_statistics import exact_percentiles
from voxtally.session import cut_lineage

VOLUME = ("subject_id", "channel")
VOXEL = ("subject_id", "x", "y", "z")


def _with_statistics(voxels: DataFrame, stats: DataFrame) -> DataFrame:
    """Voxels with the statistics of their volume. Every volume has some, so an outer join gives
    the same rows as an inner one, and only the statistics may be broadcast."""
    return voxels.dropna(subset=list(VOLUME)).join(cut_lineage(stats), list(VOLUME), "left")


def roi_masked(intensity: DataFrame, mask: DataFrame) -> DataFrame:
    """Intensity inside a mask, zero outside; ``mask`` lists the voxels it holds."""
    inside = mask.select(*VOXEL).withColumn("_in", F.lit(True))
    return by_shuffle(intensity).join(inside, list(VOXEL), "left").withColumn(
        "v", F.when(F.col("_in"), F.col("v")).otherwise(0.0)).drop("_in")


def zscore_in_mask(intensity: DataFrame, mask: Column) -> DataFrame:
    """Every voxel scaled by the mean and population deviation inside the mask."""
    stats = intensity.where(mask).groupBy(*VOLUME).agg(
        F.avg("v").alias("_mu"), (F.stddev_pop("v") + 1e-8).alias("_sd"))
    return intensity.join(cut_lineage(stats), list(VOLUME), "left").withColumn(
        "z_score", (F.col("v") - F.col("_mu")) / F.col("_sd")).drop("_mu", "_sd")


def zscore_brain(intensity: DataFrame) -> DataFrame:
    """Foreground (positive) voxels standardised, background zero.

    A constant foreground is only centred; a volume without foreground stays as it is.
    """
    front = F.when(F.col("v") > 0, F.col("v"))
    stats = intensity.groupBy(*VOLUME).agg(
        F.avg(front).alias("_mu"), F.stddev_pop(front).alias("_sd"))
    centred = F.col("v") - F.col("_mu")
    score = (
        F.when(F.col("_mu").isNull(), F.col("v"))
        .when(F.col("v") <= 0, 0.0)
        .when(F.col("_sd") > 0, centred / F.col("_sd"))
        .otherwise(centred)
    )
    return _with_statistics(intensity, stats).withColumn(
        "z_score", score).drop("_mu", "_sd")


def percentile_rescaled(intensity: DataFrame, low: float = 1.0, high: float = 99.0) -> DataFrame:
    """Clip to two percentiles and scale to [0, 1]; a flat volume becomes zero."""
    ends = exact_percentiles(intensity, VOLUME, "v", {"_lo": low / 100.0, "_hi": high / 100.0}).drop("n")
    scaled = (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return _with_statistics(intensity, ends).withColumn(
        "scaled",
        F.when(F.col("_hi") <= F.col("_lo"), 0.0)
        .otherwise(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))),
    ).drop("_lo", "_hi")


def bounding_boxes(
    intensity: DataFrame, shapes: DataFrame, *, percentile: float = 5.0, pad: int = 6
) -> DataFrame:
    """In-plane box of voxels above a whole-volume percentile, padded and clamped.

    Dense volumes only: the percentile counts background voxels. ``shapes`` has
    (subject_id, shape); a volume with nothing above gets its full extent.
    """
    cut = exact_percentiles(intensity, VOLUME, "v", {"_cut": percentile / 100.0}).drop("n")
    cut = cut_lineage(cut)
    above = lambda c: F.when(F.col("v") > F.col("_cut"), F.col(c))
    box = intensity.join(cut, list(VOLUME), "left").groupBy(*VOLUME).agg(
        F.min(above("x")).alias("x0"), F.max(above("x")).alias("x1"),
        F.min(above("y")).alias("y0"), F.max(above("y")).alias("y1"))
    full = cut.join(shapes.select("subject_id", "shape"), "subject_id").join(box, list(VOLUME), "left")
    size = {"i": F.get("shape", F.lit(0)), "j": F.get("shape", F.lit(1))}

    def start(c: str) -> Column:
        return F.coalesce(F.greatest(F.col(c) - pad, F.lit(0)), F.lit(0))

    def stop(c: str, n: Column) -> Column:
        return F.coalesce(F.least(F.col(c) + 1 + pad, n), n)

    return full.select(
        *VOLUME, start("x0").alias("i_lo"), stop("x1", size["i"]).alias("i_hi"),
        start("y0").alias("j_lo"), stop("y1", size["j"]).alias("j_hi"))


def reference_correlation(
    volumes: DataFrame, reference: Column, *, group: str = "patient_id", visit: str = "timepoint"
) -> DataFrame:
    """Pearson correlation with the reference visit per (visit, channel); NULL when flat."""
    keys = [group, "channel", "x", "y", "z"]
    base = volumes.where(reference).select(*keys, F.col("v").alias("_ref"))
    both = by_shuffle(volumes).join(base, keys)
    spread = (F.stddev_pop("v") > 0) & (F.stddev_pop("_ref") > 0)
    return both.groupBy(group, visit, "channel").agg(
        F.when(spread, F.try_divide(
            F.covar_pop("v", "_ref"), F.stddev_pop("v") * F.stddev_pop("_ref"))).alias("r"))


def label_preservation(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether a transform kept the set of labels, and both sets."""
    keys = list(keys)
    seen = (
        before.select(*keys, "label", F.lit(1).alias("_b"), F.lit(0).alias("_a"))
        .unionByName(after.select(*keys, "label", F.lit(0).alias("_b"), F.lit(1).alias("_a")))
        .groupBy(*keys, "label").agg(F.max("_b").alias("_b"), F.max("_a").alias("_a"))
    )
    listed = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.col(side) == 1, F.col("label")))), lambda v: v.cast("string")), ",")
    # The sets hold each label once, so they are as long as the label scheme.
    return seen.groupBy(*keys).agg(
        F.every(F.col("_a") == F.col("_b")).alias("labels_preserved"),
        listed("_b").alias("src_labels"), listed("_a").alias("dst_labels"))


def brain_coverage(
    labels: DataFrame,
    reference: DataFrame,
    *,
    threshold: float = 0.05,
    voxel_ml: Column | float = 0.001,
) -> DataFrame:
    """Voxels, mL and the share inside the reference brain, per label.

    The brain is where the reference intensity exceeds a share of its maximum. ``voxel_ml``
    may be an expression over ``labels`` that holds each volume's voxel size.
    """
    size = voxel_ml if isinstance(voxel_ml, Column) else F.lit(float(voxel_ml))
    top = reference.groupBy("subject_id").agg(F.max("v").alias("_max"))
    brain = by_shuffle(reference).join(top, "subject_id").where(F.col("v") > F.col("_max") * threshold).select(
        *VOXEL, F.lit(True).alias("_in"))
    return (
        by_shuffle(labels.where(F.col("label") != 0)).join(brain, list(VOXEL), "left")
        .groupBy("subject_id", "label")
        .agg(F.count(F.lit(1)).alias("voxels"), F.count("_in").alias("inside"), F.max(size).alias("_ml"))
        .select("subject_id", "label", "voxels", (F.col("voxels") * F.col("_ml")).alias("volume_ml"),
                (F.col("inside") / F.col("voxels")).alias("fraction_inside_brain"))
    )


def registration_coverage(
    expected: DataFrame,
    source: DataFrame,
    target: DataFrame,
    reference: DataFrame,
    *,
    group: str = "patient_id",
    threshold: float = 0.05,
) -> DataFrame:
    """How well comparator maps survived a transform, per group, timepoint and comparator.

    ``expected`` has a row per map that should exist, with ``src_ml`` and ``dst_ml``, the voxel
    size of the map before and after, null where its file is absent: such a map is ``missing``
    and has one row without label. A map that exists is ``ok``: its labels before and after,
    both volumes, and a row per label after the transform with voxels, mL and the share inside
    the brain of the group's reference volume (above ``threshold`` of its maximum; null
    without one). An empty map has one row without label. ``source`` and ``target`` are sparse
    voxels with the keys, x, y, z and label; ``reference`` has group, x, y, z and v.
    """
    keys = [group, "timepoint", "comparator"]
    place = [group, "x", "y", "z"]
    before, after = (side.where(F.col("label") != 0) for side in (source, target))
    top = cut_lineage(reference.groupBy(group).agg(F.max("v").alias("_max")))
    brain = by_shuffle(reference).join(top, group).where(F.col("v") > F.col("_max") * threshold).select(
        *place, F.lit(True).alias("_in"))
    per_label = cut_lineage(
        by_shuffle(after).join(brain, place, "left").groupBy(*keys, "label")
        .agg(F.count(F.lit(1)).alias("voxels"), F.count("_in").alias("inside")))
    counted = before.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    # A map has as many labels as its scheme.
    labels = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    src = counted.groupBy(*keys).agg(labels("label").alias("src_labels"), F.sum("n").alias("_src"))
    dst = per_label.groupBy(*keys).agg(labels("label").alias("dst_labels"), F.sum("voxels").alias("_dst"))
    exists = F.col("src_ml").isNotNull() & F.col("dst_ml").isNotNull()
    shown = lambda c: F.when(exists, c)
    total = lambda n: F.coalesce(F.col(n), F.lit(0))
    maps = expected.join(src, keys, "left").join(dst, keys, "left")
    maps = maps.withColumns({c: F.coalesce(c, F.lit("")) for c in ("src_labels", "dst_labels")})
    joined = maps.join(per_label, keys, "left").join(top.withColumn("_seen", F.lit(True)).drop("_max"), group, "left")
    return joined.select(
        *keys, F.when(exists, "ok").otherwise("missing").alias("status"),
        shown(F.col("src_labels") == F.col("dst_labels")).alias("labels_preserved"),
        shown(F.col("src_labels")).alias("src_labels"), shown(F.col("dst_labels")).alias("dst_labels"),
        shown(total("_src") * F.col("src_ml")).alias("src_volume_ml"),
        shown(total("_dst") * F.col("dst_ml")).alias("dst_volume_ml"),
        shown(F.col("label")).alias("label"), shown(F.col("voxels")).alias("voxels"),
        shown(F.col("voxels") * F.col("dst_ml")).alias("volume_ml"),
        shown(F.when(F.col("_seen"), F.col("inside") / F.col("voxels"))).alias("fraction_inside_brain"),
    ).distinct()
