"""Volumes over time: tables per timepoint, curve landmarks, and manifest reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtally.constants import (
    CLASS_CODES,
    COMPARTMENTS,
    FOLLOW_UP_CHANNELS,
    POST_OP,
    PRE_OP,
    PROGRESSION,
)
from voxtally.functions.labels import in_compartment
from voxtally.session import cut_lineage

CURVES = ("WT", "TC", "ET", "ED", "NCR")


def _norm(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def volumes_ml(
    cells: DataFrame,
    *,
    keys: Sequence[str] = ("subject_id",),
    label: str = "label",
    voxel_mm3: Column | float = 1.0,
) -> DataFrame:
    """Nested and disjoint volumes in mL per volume; one pass over the voxels.

    ``voxel_mm3`` may be an expression over ``cells`` that holds each volume's voxel size.
    """
    size = voxel_mm3 if isinstance(voxel_mm3, Column) else F.lit(float(voxel_mm3))
    code = F.col(label)
    counts = cells.groupBy(*keys).agg(
        *[F.count_if(in_compartment(code, c)).alias(f"vol_{c}_ml") for c in COMPARTMENTS],
        *[F.count_if(code == CLASS_CODES[c]).alias(f"vol_{c}_ml") for c in ("NCR", "ED")],
        F.max(size).alias("_mm3"),
    )
    return counts.withColumns({
        f"vol_{c}_ml": F.col(f"vol_{c}_ml") * F.col("_mm3") / 1000.0 for c in CURVES
    }).drop("_mm3")


def longitudinal_summary(volumes: DataFrame, timepoints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Manifest columns next to the volumes, in time order."""
    return timepoints.join(volumes, list(keys), "left").orderBy(
        keys[0], "days_since_baseline", *keys[1:])


def peaks(rows: DataFrame) -> DataFrame:
    """Per patient and curve, the earliest row that reaches the maximum."""
    best = rows.groupBy("patient_id").agg(*[
        F.max(F.struct(
            F.col(f"vol_{c}_ml").alias("value_ml"),
            (-F.col("days_since_baseline")).alias("neg_days"),
            F.col("timepoint"), F.col("rano"),
        )).alias(c)
        for c in CURVES
    ])
    long = best.select("patient_id", F.inline(F.array(*[
        F.struct(F.lit(c).alias("compartment"), F.col(c).alias("peak")) for c in CURVES
    ])))
    return long.select(
        "patient_id", "compartment", "peak.timepoint",
        (-F.col("peak.neg_days")).alias("days_since_baseline"), "peak.rano", "peak.value_ml",
    )


def _first(code: str) -> Column:
    """Earliest row with a response code, as (days, timepoint, volumes)."""
    row = F.struct("days_since_baseline", "timepoint", "vol_ET_ml", "vol_WT_ml")
    return F.min(F.when(_norm(F.col("rano")) == code, row))


def surgery_change(rows: DataFrame) -> DataFrame:
    """Drop of ET and change of WT across surgery; NULL unless both rows exist."""
    ends = rows.groupBy("patient_id").agg(_first(PRE_OP).alias("pre"), _first(POST_OP).alias("post"))
    return ends.select(
        "patient_id",
        (F.col("pre.vol_ET_ml") - F.col("post.vol_ET_ml")).alias("postop_ET_drop_ml"),
        (F.col("post.vol_WT_ml") - F.col("pre.vol_WT_ml")).alias("postop_WT_change_ml"),
    )


def recurrence(rows: DataFrame) -> DataFrame:
    """Trough of ET before the first progression, the last progression, and the rise.

    The trough is sought from surgery (included) to the first progression (excluded).
    """
    last = F.max(F.when(
        _norm(F.col("rano")) == PROGRESSION,
        F.struct("days_since_baseline", "timepoint", "vol_ET_ml")))
    marks = rows.groupBy("patient_id").agg(
        _first(POST_OP).alias("post"), _first(PROGRESSION).alias("first_pd"), last.alias("last_pd")
    ).where(F.col("first_pd").isNotNull()).select(
        "patient_id", F.col("post.days_since_baseline").alias("post_day"),
        F.col("first_pd.days_since_baseline").alias("pd_day"), "last_pd")
    in_window = (
        F.col("post_day").isNull() | (F.col("days_since_baseline") >= F.col("post_day"))
    ) & (F.col("days_since_baseline") < F.col("pd_day"))
    troughs = (
        rows.join(marks.drop("last_pd"), "patient_id").where(in_window)
        .groupBy("patient_id")
        .agg(F.min(F.struct("vol_ET_ml", "days_since_baseline", "timepoint")).alias("trough"))
    )
    return marks.join(troughs, "patient_id", "left").select(
        "patient_id",
        F.col("trough.vol_ET_ml").alias("recurrence_ET_trough_ml"),
        F.col("trough.timepoint").alias("recurrence_ET_trough_timepoint"),
        F.col("last_pd.vol_ET_ml").alias("recurrence_ET_at_last_PD_ml"),
        F.col("last_pd.timepoint").alias("recurrence_ET_last_PD_timepoint"),
        (F.col("last_pd.vol_ET_ml") - F.col("trough.vol_ET_ml")).alias("recurrence_ET_rise_ml"),
    )


# ------------------------------------------------------------------ regions over time

def _follow_up(table: DataFrame) -> DataFrame:
    return table.withColumn("vol_ml", F.col("overlap_volume_mm3") / 1000.0)


def top_regions_over_time(table: DataFrame, k: int) -> DataFrame:
    """Regions by their largest volume over time; Unknown and never-positive ones drop out."""
    best = (
        _follow_up(table).where(F.col("name") != "Unknown")
        .groupBy("subject_id", "compartment", "name")
        .agg(F.max("vol_ml").alias("max_ml"))
        .where(F.col("max_ml") > 0)
    )
    order = W.partitionBy("subject_id", "compartment").orderBy(F.desc("max_ml"), "name")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def region_by_timepoint(table: DataFrame, timepoints: Sequence, k: int) -> DataFrame:
    """The top regions with one mL column per timepoint, zero where absent.

    Labels that share a name keep the last row of the table order, not their sum.
    """
    keys = ["subject_id", "compartment", "name"]
    top = cut_lineage(top_regions_over_time(table, k))
    # Rows are ordered within a key, by sorting; only those of the few top regions need be.
    last = _follow_up(table).join(top.select(*keys), keys, "left_semi").groupBy("subject_id", "compartment", "name", "timepoint").agg(
        F.min_by("vol_ml", F.struct(F.col("pct_of_parcel"), -F.col("label"))).alias("vol_ml"))
    wide = (
        last.groupBy("subject_id", "compartment", "name")
        .pivot("timepoint", list(timepoints)).agg(F.max("vol_ml"))
    )
    names = [str(t) for t in timepoints]
    wide = wide.select(
        "subject_id", "compartment", "name",
        *[F.coalesce(F.col(f"`{t}`"), F.lit(0.0)).alias(f"tp_{t}") for t in names])
    return top.join(wide, keys)


def timepoint_totals(table: DataFrame) -> DataFrame:
    """Total mL per timepoint and compartment, with and without the Unknown region."""
    named = F.when(F.col("name") != "Unknown", F.col("vol_ml")).otherwise(0.0)
    return _follow_up(table).groupBy("subject_id", "timepoint", "compartment").agg(
        F.sum("vol_ml").alias("total_ml"), F.sum(named).alias("total_named_ml"))


# ------------------------------------------------------------------ manifests

def manifest_status(manifest: DataFrame, sidecars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every timepoint of the manifest; ``missing`` where no sidecar was written."""
    found = sidecars.withColumn("_found", F.lit(True))
    return manifest.join(found, list(keys), "left").withColumn(
        "status", F.when(F.col("_found").isNull(), "missing").otherwise("ok")).drop("_found")


def merge_response(rows: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The manifest's response code wins where it has one; the row's own is the fallback."""
    meta = manifest.select(
        *keys, F.col("rano").alias("_rano"), F.col("rano_rationale").alias("_why"))
    own = F.nullif(F.trim("_rano"), F.lit(""))
    return rows.join(meta, list(keys), "left").withColumns({
        "rano": F.coalesce(own, F.col("rano")),
        "rano_rationale": F.coalesce(F.trim("_why"), F.lit("")),
    }).drop("_rano", "_why")


def scanner_per_channel(
    timepoints: DataFrame,
    scans: DataFrame,
    *,
    order: Sequence[str],
    channels: Sequence[str] = FOLLOW_UP_CHANNELS,
) -> DataFrame:
    """First scan of every (patient, timepoint, channel) in file order, ``?`` where unknown."""
    fields = ["manufacturer", "model", "voxel_size"]
    first = scans.groupBy(
        _norm(F.col("patient_id")).alias("_p"), _norm(F.col("timepoint")).alias("_t"),
        _norm(F.col("sequence")).alias("_c"),
    ).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("scan"))
    wanted = timepoints.select("patient_id", "timepoint").distinct().withColumn(
        "channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    joined = wanted.join(
        first,
        (_norm(F.col("patient_id")) == F.col("_p")) & (_norm(F.col("timepoint")) == F.col("_t"))
        & (_norm(F.col("channel")) == F.col("_c")),
        "left",
    )
    known = lambda f: F.trim(F.coalesce(
        F.nullif(F.col(f"scan.{f}"), F.lit("")), F.lit("?")))
    return joined.select(
        "patient_id", "timepoint", "channel", *[known(f).alias(f) for f in fields])


# ------------------------------------------------------------------ drift

def text_rule(manifest: Column, source: Column) -> Column:
    return F.when(_norm(manifest) != _norm(source), "differs")


def initial_rule(manifest: Column, source: Column) -> Column:
    return F.when(F.substring(_norm(manifest), 1, 1) != F.substring(_norm(source), 1, 1), "differs")


def wild_type_rule(manifest: Column, source: Column) -> Column:
    """A manifest that says wild type needs a source that implies it."""
    return F.when((_norm(manifest) == "wt") & ~_norm(source).rlike("neg|wild|wt"), "differs")


def integer_rule(manifest: Column, source: Column) -> Column:
    number = F.trim(source).try_cast("double")
    number = F.when(~F.isnan(number) & (F.abs(number) < 9e18), number)
    return F.when(number.isNull(), "unparseable").when(
        number.cast("bigint") != F.coalesce(manifest.cast("bigint"), F.lit(-1)), "differs")


def percent_rule(manifest: Column, source: Column, tolerance: float = 1e-3) -> Column:
    number = F.regexp_replace(_norm(source), "%+$", "").try_cast("double")
    gap = F.abs(number - F.coalesce(manifest.cast("double"), F.lit(-1.0)))
    return F.when(number.isNull(), "unparseable").when(gap > tolerance, "differs")


def drift(
    manifest: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    rules: Mapping[str, object],
    *,
    order: Sequence[str],
    keep: str = "first",
) -> DataFrame:
    """One row per field that disagrees, per absent row, and per ambiguous row.

    ``rules`` maps a field, present on both sides, to one of the rules above. Keys compare
    without case and surrounding blanks. Several source rows: the first (or last) counts.
    """
    place = F.struct(*order)
    row = F.struct(*rules)
    pick = F.min_by(row, place) if keep == "first" else F.max_by(row, place)
    norm_keys = [f"_k{i}" for i in range(len(keys))]
    theirs = source.groupBy(*[_norm(F.col(k)).alias(n) for k, n in zip(keys, norm_keys)]).agg(
        pick.alias("_row"), F.count(F.lit(1)).alias("_rows"))
    ours = manifest.withColumns({n: _norm(F.col(k)) for k, n in zip(keys, norm_keys)})
    both = ours.join(theirs, norm_keys, "left")
    checks = [
        F.struct(
            F.lit(field).alias("field"), F.col(field).cast("string").alias("manifest_value"),
            F.col(f"_row.{field}").cast("string").alias("source_value"),
            F.when(F.col("_row").isNotNull(), rule(F.col(field), F.col(f"_row.{field}")))
            .alias("problem"),
        )
        for field, rule in rules.items()
    ]
    empty = F.lit(None).cast("string")
    rows = F.struct(
        F.lit("row").alias("field"), empty.alias("manifest_value"), empty.alias("source_value"),
        F.when(F.col("_row").isNull(), "no row")
        .when((F.col("_rows") > 1) if keep == "first" else F.lit(False), "several rows")
        .alias("problem"),
    )
    return both.select(*keys, F.inline(F.array(rows, *checks))).where(F.col("problem").isNotNull())
