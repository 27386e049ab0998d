"""Agreement between two label maps, and between two region tables over a cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.constants import CLASS_CODES, COMPARATOR_COMPARTMENTS, COMPARTMENTS, RAW_CODES
from voxtally.functions import agreement as stat
from voxtally.functions.columns import by_shuffle
from voxtally.functions.labels import comparator_in_compartment, in_compartment

PAIR_KEYS = ("subject_id", "label", "compartment")


def _mask_counts(pred: Column, ref: Column, name: str) -> list[Column]:
    return [
        F.count_if(pred).alias(f"_p_{name}"),
        F.count_if(ref).alias(f"_g_{name}"),
        F.count_if(pred & ref).alias(f"_b_{name}"),
    ]


def _unfold(wide: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    return wide.select(
        *keys,
        F.inline(F.array(*[
            F.struct(
                F.lit(c).alias("compartment"),
                F.col(f"_p_{c}").alias("n_pred"),
                F.col(f"_g_{c}").alias("n_ref"),
                F.col(f"_b_{c}").alias("n_both"),
                F.col("_n").alias("n_grid"),
            )
            for c in names
        ])),
    )


def confusion_counts(
    cells: DataFrame,
    *,
    keys: Sequence[str] = ("subject_id",),
    pred: str = "pred",
    ref: str = "ref",
    grids: DataFrame | None = None,
) -> DataFrame:
    """Voxel counts per compartment from one pass over co-registered labels.

    With sparse voxels the grid size comes from ``grids`` (``shape`` per volume), and a
    volume without a single voxel still gets its rows; otherwise every cell is a row.
    """
    keys = list(keys)
    wide = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[
            column
            for c in COMPARTMENTS
            for column in _mask_counts(
                in_compartment(F.col(pred), c), in_compartment(F.col(ref), c), c)
        ],
    )
    if grids is not None:
        shape = F.col("shape").cast("array<bigint>")
        size = grids.select(
            *keys, (F.get(shape, F.lit(0)) * F.get(shape, F.lit(1)) * F.get(shape, F.lit(2)))
            .alias("_grid"))
        counts = [c for c in wide.columns if c.startswith("_") and c != "_n"]
        wide = (
            size.join(wide, keys, "left")
            .na.fill(0, counts)
            .withColumn("_n", F.col("_grid"))
        )
    return _unfold(wide, keys, COMPARTMENTS)


def overlap_metrics(counts: DataFrame, voxel_mm3: Column | float = 1.0) -> DataFrame:
    """Every count-based metric; NULL where its denominator is empty."""
    p, g, both, n = (F.col(c) for c in ("n_pred", "n_ref", "n_both", "n_grid"))
    mm3 = voxel_mm3 if isinstance(voxel_mm3, Column) else F.lit(float(voxel_mm3))
    error = stat.volume_error(p, g, mm3)
    return counts.withColumns({
        "dice": stat.dice(p, g, both),
        "jaccard": stat.jaccard(p, g, both),
        "sensitivity": stat.sensitivity(g, both),
        "specificity": stat.specificity(n, p, g, both),
        "volumetric_error_mm3": error,
        "abs_volumetric_error_mm3": F.abs(error),
    })


def aligned_pair(pred: DataFrame, ref: DataFrame, grids: DataFrame | None = None) -> DataFrame:
    """Two sparse label maps cell by cell; a voxel one side lacks is background there.

    ``grids`` holds one shape per (subject, source); differing shapes abort the job.
    """
    keys = ["subject_id", "x", "y", "z"]
    both = pred.select(*keys, F.col("label").alias("pred")).join(
        ref.select(*keys, F.col("label").alias("ref")), keys, "full"
    ).na.fill(0, ["pred", "ref"])
    if grids is None:
        return both
    shapes = grids.groupBy("subject_id").agg(F.count_distinct("shape").alias("_shapes"))
    checked = both.join(shapes, "subject_id", "left")
    return checked.withColumn(
        "pred",
        F.when(F.coalesce("_shapes", F.lit(1)) > 1,
               F.raise_error(F.concat(F.lit("shape mismatch for subject "), F.col("subject_id"))))
        .otherwise(F.col("pred")),
    ).drop("_shapes")


def comparator_agreement(
    cells: DataFrame,
    *,
    keys: Sequence[str],
    comparators: dict[str, str],
    voxel_mm3: Column | float = 1.0,
    label: str = "pred",
) -> DataFrame:
    """Our map against comparators that resolve only some compartments.

    ``voxel_mm3`` may be an expression over ``cells`` that holds each volume's voxel size.

    ``comparators`` maps a kind to the column with that comparator's own codes. A pair is
    skipped where the comparator has no definition of the compartment; a volume whose
    comparator column is all NULL (no such map) gives no rows.
    """
    keys, wide, seen = list(keys), [], []
    for kind, column in comparators.items():
        for c in COMPARTMENTS:
            theirs = comparator_in_compartment(F.col(column), kind, c)
            if theirs is None:
                continue
            seen.append((kind, c))
            wide += _mask_counts(in_compartment(F.col(label), c), theirs, f"{kind}_{c}")
        wide.append(F.count(column).alias(f"_n_{kind}"))
    size = voxel_mm3 if isinstance(voxel_mm3, Column) else F.lit(float(voxel_mm3))
    counts = cells.groupBy(*keys).agg(*wide, F.max(size).alias("_mm3"))
    long = counts.select(*keys, "_mm3", F.inline(F.array(*[
        F.struct(
            F.lit(kind).alias("kind"), F.lit(c).alias("compartment"),
            F.col(f"_p_{kind}_{c}").alias("n_pred"), F.col(f"_g_{kind}_{c}").alias("n_ref"),
            F.col(f"_b_{kind}_{c}").alias("n_both"), F.col(f"_n_{kind}").alias("n_cells"),
        )
        for kind, c in seen
    ]))).where(F.col("n_cells") > 0)
    p, g, both = F.col("n_pred"), F.col("n_ref"), F.col("n_both")
    ml = F.col("_mm3") / 1000.0
    return long.select(
        *keys, "kind", "compartment",
        stat.dice(p, g, both).alias("dice"), stat.jaccard(p, g, both).alias("jaccard"),
        (p * ml).alias("vol_pred_ml"), (g * ml).alias("vol_comparator_ml"),
        (p * ml - g * ml).alias("vol_diff_ml"),
    )


def comparator_pairs(grids: DataFrame, keys: Sequence[str], reference: str = "dl") -> DataFrame:
    """One row per comparator volume that has one of ours: keys, kind, both shapes, and status
    ``ok`` or ``shape mismatch``. ``grids`` has keys, source and shape of every volume."""
    ours = grids.where(F.col("source") == reference).select(*keys, F.col("shape").alias("ref_shape"))
    theirs = grids.where(F.col("source") != reference).select(
        *keys, F.col("source").alias("kind"), F.col("shape").alias("comparator_shape"))
    same = F.col("ref_shape") == F.col("comparator_shape")
    return theirs.join(ours, list(keys)).withColumn(
        "status", F.when(same, "ok").otherwise("shape mismatch"))


def checked_comparator_agreement(
    ours: DataFrame,
    theirs: DataFrame,
    grids: DataFrame,
    *,
    keys: Sequence[str],
    kinds: Sequence[str] = tuple(COMPARATOR_COMPARTMENTS),
    reference: str = "dl",
) -> DataFrame:
    """Our sparse map (keys, x, y, z, label) against sparse maps of comparators (and kind).

    Volumes are paired by their grids first. A pair of different shapes comes out once, with
    both shapes and without compartment, and its voxels reach no join; a pair of one shape
    comes out per compartment that the comparator resolves. ``grids`` also has ``voxel_mm3``,
    of which ours counts. Only voxels both maps label are joined: the sizes of the masks are
    counted on each side alone, so an empty map still gives its zeros.
    """
    keys = list(keys)
    pairs = comparator_pairs(grids.where(F.col("source").isin(reference, *kinds)), keys, reference)
    fits = pairs.where(F.col("status") == "ok").select(*keys, "kind")
    size = grids.where(F.col("source") == reference).select(*keys, (F.col("voxel_mm3") / 1000.0).alias("_ml"))
    seen = [(kind, c) for kind in kinds for c in COMPARTMENTS if c in COMPARATOR_COMPARTMENTS[kind]]
    inside = {(kind, c): comparator_in_compartment(F.col("_theirs"), kind, c) & (F.col("kind") == kind)
              for kind, c in seen}

    n_pred = ours.groupBy(*keys).agg(*[
        F.count_if(in_compartment(F.col("label"), c)).alias(f"_p_{c}") for c in COMPARTMENTS])
    codes = theirs.select(*keys, "kind", "x", "y", "z", F.col("label").alias("_theirs")).join(fits, [*keys, "kind"], "left_semi")
    n_ref = codes.groupBy(*keys, "kind").agg(*[F.count_if(m).alias(f"_g_{k}_{c}") for (k, c), m in inside.items()])
    n_both = by_shuffle(codes).join(ours.select(*keys, "x", "y", "z", "label"), [*keys, "x", "y", "z"]).groupBy(*keys, "kind").agg(*[
        F.count_if(m & in_compartment(F.col("label"), c)).alias(f"_b_{k}_{c}") for (k, c), m in inside.items()])

    wide = pairs.join(n_pred, keys, "left").join(n_ref, [*keys, "kind"], "left").join(n_both, [*keys, "kind"], "left") \
        .join(size, keys, "left")
    wide = wide.na.fill(0, [c for c in wide.columns if c[:3] in ("_p_", "_g_", "_b_")])
    row = lambda c, p, g, both: F.struct(
        c.alias("compartment"), p.alias("_p"), g.alias("_g"), both.alias("_b"))
    none = F.lit(None).cast("bigint")
    of_kind = [
        F.when((F.col("status") == "ok") & (F.col("kind") == kind), F.array(*[
            row(F.lit(c), F.col(f"_p_{c}"), F.col(f"_g_{kind}_{c}"), F.col(f"_b_{kind}_{c}"))
            for k, c in seen if k == kind]))
        for kind in kinds]
    long = wide.select(*keys, "kind", "status", "ref_shape", "comparator_shape", "_ml", F.inline(
        F.coalesce(*of_kind, F.array(row(F.lit(None).cast("string"), none, none, none)))))
    p, g, both, ml = F.col("_p"), F.col("_g"), F.col("_b"), F.col("_ml")
    return long.select(
        *keys, "kind", "status", "ref_shape", "comparator_shape", "compartment",
        stat.dice(p, g, both).alias("dice"), stat.jaccard(p, g, both).alias("jaccard"),
        (p * ml).alias("vol_pred_ml"), (g * ml).alias("vol_comparator_ml"), (p * ml - g * ml).alias("vol_diff_ml"))


# ------------------------------------------------------------------ region tables

def region_pairs(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """Cells both tables have, with both coverages present, and their differences."""
    side = lambda df, tag: df.select(
        *PAIR_KEYS,
        F.col("pct_of_parcel").alias(f"pct_{tag}"),
        F.col("overlap_volume_mm3").alias(f"vol_{tag}"),
    )
    joined = side(pred, "pred").join(side(ref, "ref"), list(PAIR_KEYS))
    return pair_differences(joined.where(
        F.col("pct_pred").isNotNull() & F.col("pct_ref").isNotNull()))


def pair_differences(pairs: DataFrame) -> DataFrame:
    pct_pred, pct_ref = F.col("pct_pred"), F.col("pct_ref")
    return pairs.withColumns({
        "diff_pct": pct_pred - pct_ref,
        "mean_pct": 0.5 * (pct_pred + pct_ref),
        "abs_diff_volume_mm3": F.abs(F.col("vol_pred") - F.col("vol_ref")),
    })


def pair_problems(subjects: DataFrame, pred: DataFrame, ref: DataFrame) -> DataFrame:
    """Subjects of the cohort that contribute no pair, with the first reason."""
    has = lambda df, tag: df.select(
        "subject_id").distinct().withColumn(tag, F.lit(True))
    keys = list(PAIR_KEYS)
    shared = pred.select(*keys, F.col("pct_of_parcel").alias("_p")).join(
        ref.select(*keys, F.col("pct_of_parcel").alias("_r")), keys
    ).groupBy("subject_id").agg(
        F.count_if(F.col("_p").isNotNull() & F.col("_r").isNotNull()).alias("usable"))
    seen = (
        subjects.select("subject_id").distinct()
        .join(has(pred, "in_pred"), "subject_id", "left")
        .join(has(ref, "in_ref"), "subject_id", "left")
        .join(shared, "subject_id", "left")
    )
    reason = (
        F.when(F.col("in_pred").isNull(), "prediction table not found")
        .when(F.col("in_ref").isNull(), "reference table not found")
        .when(F.col("usable").isNull(), "empty join")
        .when(F.col("usable") == 0, "all pairs missing")
    )
    return seen.select("subject_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def limits_of_agreement(pairs: DataFrame) -> DataFrame:
    """Concordance and limits of agreement per compartment, every compartment present."""
    x, y = F.col("pct_pred"), F.col("pct_ref")
    mean, sd, low, high = stat.limits_of_agreement(F.col("diff_pct"))
    summary = pairs.groupBy("compartment").agg(
        stat.concordance(x, y).alias("ccc"),
        mean.alias("mean_diff_pct"), sd.alias("std_diff_pct"),
        low.alias("loa_lower_pct"), high.alias("loa_upper_pct"),
        F.avg("abs_diff_volume_mm3").alias("mean_abs_diff_volume_mm3"),
        F.count(F.lit(1)).alias("n_pairs"),
    )
    # Distinct counts go through their own two-step aggregates: no per-group set is built.
    per_subject = pairs.groupBy("compartment", "subject_id").agg(F.lit(1).alias("_")) \
        .groupBy("compartment").agg(F.count("_").alias("n_subjects"))
    per_region = pairs.groupBy("compartment", "label").agg(F.lit(1).alias("_")) \
        .groupBy("compartment").agg(F.count("_").alias("n_regions"))
    domain = pairs.sparkSession.createDataFrame(
        [(c,) for c in COMPARTMENTS], "compartment STRING")
    return (
        domain.join(summary, "compartment", "left")
        .join(per_subject, "compartment", "left")
        .join(per_region, "compartment", "left")
        .na.fill(0, ["n_pairs", "n_subjects", "n_regions"])
    )


def subject_residuals(pairs: DataFrame) -> DataFrame:
    """Mean absolute volume difference per subject."""
    return pairs.groupBy("subject_id").agg(
        F.avg("abs_diff_volume_mm3").alias("mean_abs_residual"))


def cohort_residual(pairs: DataFrame) -> DataFrame:
    """Mean of the subject means."""
    return subject_residuals(pairs).agg(
        F.avg("mean_abs_residual").alias("cohort_mean_abs_residual"))


def representative_subjects(pairs: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` subjects closest to the cohort mean; the id breaks ties."""
    each = subject_residuals(pairs)
    mean = cohort_residual(pairs).scalar()
    return (
        each.withColumn("distance", F.abs(F.col("mean_abs_residual") - mean))
        .orderBy("distance", "subject_id")
        .limit(n)
    )


# ------------------------------------------------------------------ raw-code crosswalk

def raw_label_crosswalk(cells: DataFrame, comparators: Sequence[str] = ("pred", "ref")) -> DataFrame:
    """Overlap of every raw code with every class of every comparator, zero rows included."""
    counts = [
        F.count_if(F.col("raw") == r).alias(f"_raw_{r}") for r in RAW_CODES
    ] + [
        F.count_if(F.col(m) == code).alias(f"_{m}_{name}")
        for m in comparators for name, code in CLASS_CODES.items()
    ] + [
        F.count_if((F.col("raw") == r) & (F.col(m) == code)).alias(f"_{m}_{name}_{r}")
        for r in RAW_CODES for m in comparators for name, code in CLASS_CODES.items()
    ]
    wide = cells.groupBy("subject_id").agg(*counts)
    long = wide.select("subject_id", F.inline(F.array(*[
        F.struct(
            F.lit(r).alias("raw_label"), F.lit(m).alias("comparator"),
            F.lit(name).alias("target_class"),
            F.col(f"_{m}_{name}_{r}").alias("intersection_voxels"),
            F.col(f"_raw_{r}").alias("raw_label_voxels"),
            F.col(f"_{m}_{name}").alias("target_voxels"),
        )
        for r in RAW_CODES for m in comparators for name in CLASS_CODES
    ])))
    return long.withColumn("dice", stat.dice(
        F.col("raw_label_voxels"), F.col("target_voxels"), F.col("intersection_voxels")))


def best_matches(crosswalk: DataFrame) -> DataFrame:
    """Best class per (subject, raw code, comparator): dice, then overlap, then class order."""
    place = F.create_map(*[x for i, c in enumerate(CLASS_CODES) for x in (F.lit(c), F.lit(-i))])
    rank = F.struct(
        F.coalesce("dice", F.lit(-1.0)), F.col("intersection_voxels"),
        place[F.col("target_class")],
    )
    row = F.struct("target_class", "dice", "intersection_voxels", "raw_label_voxels", "target_voxels")
    best = crosswalk.groupBy("subject_id", "raw_label", "comparator").agg(
        F.max_by(row, rank).alias("best"))
    return best.select(
        "subject_id", "raw_label", "comparator",
        F.col("best.target_class").alias("best_target_class"),
        F.col("best.dice").alias("best_dice"),
        "best.intersection_voxels", "best.raw_label_voxels", "best.target_voxels",
    )


def vote_counts(best: DataFrame) -> DataFrame:
    """How many subjects vote for a class, per raw code and comparator."""
    return best.groupBy("raw_label", "comparator", "best_target_class").agg(
        F.count(F.lit(1)).alias("votes"))


