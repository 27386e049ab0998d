"""Intensity operators over the dense ``intensity`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtally.operators import intensity as ops
from voxtally.plans import bindings as b
from voxtally.plans.bindings import CELLS_SQL, INTENSITY_SQL, VOLUMES_SQL, with_ctes
from voxtally.plans.registry import query
from voxtally.session import run_folder
from voxtally.sources.stored_voxels import store_voxels

COLUMNS = ["subject_id", "channel", "x", "y", "z"]


MASKED_SQL = with_ctes(INTENSITY_SQL, select="""
SELECT subject_id, channel, x, y, z, CASE WHEN in_mask THEN v ELSE 0 END AS v FROM intensity""")


@query("p22_roi_masking", MASKED_SQL)
def p22(spark, folder):
    volumes = b.intensity(spark, folder)
    mask = volumes.where("in_mask AND channel = 'T1'")
    return ops.roi_masked(volumes, mask).select(*COLUMNS, "v")


@query("p22_stored_masking", MASKED_SQL)
def p22_stored(spark, folder):
    path, volumes = run_folder(spark, "masked"), b.intensity(spark, folder)
    mask = store_voxels(volumes.where("in_mask AND channel = 'T1'").select(*ops.VOXEL), f"{path}/mask")
    return ops.roi_masked(store_voxels(volumes.drop("in_mask"), f"{path}/volumes"), mask).select(*COLUMNS, "v")


@query("p23_zscore_in_mask", with_ctes(INTENSITY_SQL, """
st AS (SELECT subject_id, channel, avg(v) AS mu, stddev_pop(v) + 1e-8 AS sd FROM intensity WHERE in_mask GROUP BY 1, 2)""",
       select="""
SELECT subject_id, channel, x, y, z, CASE WHEN sd > 1e-6 THEN (v - mu) / sd ELSE sign(v - mu) END AS z_score
FROM intensity JOIN st USING (subject_id, channel)"""), rounded=["z_score"])
def p23(spark, folder):
    """A flat mask divides by 1e-8, which only the sign of the result is compared for."""
    scored = ops.zscore_in_mask(b.intensity(spark, folder), F.col("in_mask"))
    z = F.col("z_score")
    return scored.select(*COLUMNS, F.when(F.abs(z) > 1e6, F.signum(z)).otherwise(z).alias("z_score"))


@query("p24_zscore_brain", with_ctes(INTENSITY_SQL, """
st AS (SELECT subject_id, channel, avg(v) FILTER (WHERE v > 0) AS mu, stddev_pop(v) FILTER (WHERE v > 0) AS sd
       FROM intensity GROUP BY 1, 2)""", select="""
SELECT subject_id, channel, x, y, z, CASE WHEN mu IS NULL THEN v WHEN v <= 0 THEN 0 WHEN sd > 0 THEN (v - mu) / sd
  ELSE v - mu END AS z_score FROM intensity JOIN st USING (subject_id, channel)"""), rounded=["z_score"])
def p24(spark, folder):
    return ops.zscore_brain(b.intensity(spark, folder)).select(*COLUMNS, "z_score")


@query("p25_percentile_rescale", with_ctes(INTENSITY_SQL, """
st AS (SELECT subject_id, channel, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi
       FROM intensity GROUP BY 1, 2)""", select="""
SELECT subject_id, channel, x, y, z, CASE WHEN hi <= lo THEN 0
  ELSE least(greatest((v - lo) / (hi - lo), 0), 1) END AS scaled
FROM intensity JOIN st USING (subject_id, channel)"""), rounded=["scaled"])
def p25(spark, folder):
    return ops.percentile_rescaled(b.intensity(spark, folder)).select(*COLUMNS, "scaled")


def box_shapes(spark, folder):
    return b.grids(spark, folder).select(
        "subject_id", F.array(*[F.lit(b.SIDE)] * 3).alias("shape"))


@query("a39_bounding_box", with_ctes(INTENSITY_SQL, """
st AS (SELECT subject_id, channel, quantile_cont(v, 0.5) AS cut FROM intensity GROUP BY 1, 2),
bx AS (SELECT subject_id, channel, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1
       FROM intensity JOIN st USING (subject_id, channel) WHERE v > cut GROUP BY 1, 2)""", select="""
SELECT subject_id, channel, coalesce(greatest(x0 - 1, 0), 0) AS i_lo, coalesce(least(x1 + 2, 8), 8) AS i_hi,
       coalesce(greatest(y0 - 1, 0), 0) AS j_lo, coalesce(least(y1 + 2, 8), 8) AS j_hi
FROM st LEFT JOIN bx USING (subject_id, channel)"""))
def a39(spark, folder):
    return ops.bounding_boxes(
        b.intensity(spark, folder), box_shapes(spark, folder), percentile=50.0, pad=1)


def visits(spark, folder):
    number = F.col("subject_id").cast("int")
    return b.intensity(spark, folder).select(
        F.floor(number / 10).cast("int").alias("patient_id"),
        (number % 10).alias("timepoint"), "channel", "x", "y", "z", "v")


CORRELATION_SQL = with_ctes(INTENSITY_SQL, """
vis AS (SELECT CAST(subject_id AS INTEGER) // 10 AS patient_id, CAST(subject_id AS INTEGER) % 10 AS timepoint,
               channel, x, y, z, v FROM intensity)""", select="""
SELECT a.patient_id, a.timepoint, a.channel,
  CASE WHEN stddev_pop(a.v) > 0 AND stddev_pop(r.v) > 0
       THEN covar_pop(a.v, r.v) / (stddev_pop(a.v) * stddev_pop(r.v)) END AS r
FROM vis a JOIN vis r ON r.timepoint = 0 AND r.patient_id = a.patient_id AND r.channel = a.channel
  AND r.x = a.x AND r.y = a.y AND r.z = a.z GROUP BY 1, 2, 3""")


@query("a30_reference_correlation", CORRELATION_SQL, rounded=["r"])
def a30(spark, folder):
    return ops.reference_correlation(visits(spark, folder), F.col("timepoint") == 0)


@query("a30_stored_correlation", CORRELATION_SQL, rounded=["r"])
def a30_stored(spark, folder):
    stored = store_voxels(
        visits(spark, folder), run_folder(spark, "visits"), keys=["patient_id", "channel", "x", "y", "z"])
    return ops.reference_correlation(stored, F.col("timepoint") == 0)


@query("a31_label_preservation", with_ctes(CELLS_SQL, """
bf AS (SELECT DISTINCT subject_id, raw AS label FROM cells),
af AS (SELECT DISTINCT subject_id, CASE WHEN CAST(subject_id AS INTEGER) % 3 = 0 AND raw = 3 THEN 2 ELSE raw END AS label FROM cells),
x AS (SELECT subject_id, string_agg(label, ',' ORDER BY label) AS src_labels FROM bf GROUP BY 1),
y AS (SELECT subject_id, string_agg(label, ',' ORDER BY label) AS dst_labels FROM af GROUP BY 1)""", select="""
SELECT subject_id, src_labels = dst_labels AS labels_preserved, src_labels, dst_labels FROM x JOIN y USING (subject_id)"""))
def a31(spark, folder):
    cells = b.cells(spark, folder)
    before = cells.select("subject_id", F.col("raw").alias("label"))
    lost = (F.col("subject_id").cast("int") % 3 == 0) & (F.col("raw") == 3)
    after = cells.select("subject_id", F.when(lost, 2).otherwise(F.col("raw")).alias("label"))
    return ops.label_preservation(before, after, ["subject_id"])


@query("a32_brain_coverage", with_ctes(VOLUMES_SQL, INTENSITY_SQL, """
t1 AS (SELECT * FROM intensity WHERE channel = 'T1'),
br AS (SELECT subject_id, x, y, z, true AS inside FROM t1
       JOIN (SELECT subject_id, max(v) AS m FROM t1 GROUP BY 1) USING (subject_id) WHERE v > m * 0.05::DOUBLE)""",
       select="""
SELECT subject_id, pred AS label, count(*) AS voxels, count(*) * 0.001::DOUBLE AS volume_ml,
       count(inside)::DOUBLE / count(*) AS fraction_inside_brain
FROM volumes LEFT JOIN br USING (subject_id, x, y, z) WHERE pred <> 0 GROUP BY 1, 2"""),
       rounded=["volume_ml", "fraction_inside_brain"])
def a32(spark, folder):
    labels = b.volumes(spark, folder).select("subject_id", "x", "y", "z", F.col("pred").alias("label"))
    return ops.brain_coverage(labels, b.intensity(spark, folder).where("channel = 'T1'"))


@query("a32_registration_coverage", with_ctes(VOLUMES_SQL, INTENSITY_SQL, """
who AS (SELECT subject_id, CAST(subject_id AS INTEGER) // 10 AS patient_id, CAST(subject_id AS INTEGER) % 10 AS timepoint,
          comparator, sx * sy * sz / 1000.0::DOUBLE AS src_ml,
          CASE WHEN NOT (comparator = 'hdglio' AND CAST(subject_id AS INTEGER) % 8 = 5) THEN 0.001::DOUBLE END AS dst_ml
        FROM grids, (VALUES ('hdglio'), ('deepbratumia')) AS v(comparator)),
br AS (SELECT CAST(subject_id AS INTEGER) // 10 AS patient_id, x, y, z, true AS inside FROM intensity
       JOIN (SELECT subject_id, max(v) AS m FROM intensity WHERE channel = 'T1' GROUP BY 1) USING (subject_id)
       WHERE channel = 'T1' AND CAST(subject_id AS INTEGER) % 10 = 0 AND v > m * 0.05::DOUBLE),
rf AS (SELECT DISTINCT patient_id, true AS seen FROM br),
s AS (SELECT subject_id, string_agg(DISTINCT ref, ',' ORDER BY ref) AS l, count(*) AS n FROM volumes WHERE ref > 0 GROUP BY 1),
tv AS (SELECT w.subject_id, w.comparator, CASE WHEN comparator = 'hdglio' AND pred = 4 THEN 2 ELSE pred END AS label, x, y, z, patient_id
       FROM who w JOIN volumes USING (subject_id) WHERE pred > 0),
d AS (SELECT subject_id, comparator, string_agg(DISTINCT label, ',' ORDER BY label) AS l, count(*) AS n FROM tv GROUP BY 1, 2),
pl AS (SELECT tv.subject_id, comparator, label, count(*) AS voxels, count(inside) AS inside
       FROM tv LEFT JOIN br USING (patient_id, x, y, z) GROUP BY 1, 2, 3)""", select="""
SELECT w.patient_id, w.timepoint, w.comparator, CASE WHEN dst_ml IS NULL THEN 'missing' ELSE 'ok' END AS status,
  CASE WHEN dst_ml IS NOT NULL THEN coalesce(s.l, '') = coalesce(d.l, '') END AS labels_preserved,
  CASE WHEN dst_ml IS NOT NULL THEN coalesce(s.l, '') END AS src_labels, CASE WHEN dst_ml IS NOT NULL THEN coalesce(d.l, '') END AS dst_labels,
  CASE WHEN dst_ml IS NOT NULL THEN coalesce(s.n, 0) * src_ml END AS src_volume_ml, coalesce(d.n, 0) * dst_ml AS dst_volume_ml,
  pl.label, pl.voxels, pl.voxels * dst_ml AS volume_ml,
  CASE WHEN seen THEN pl.inside::DOUBLE / pl.voxels END AS fraction_inside_brain
FROM who w LEFT JOIN s USING (subject_id) LEFT JOIN d USING (subject_id, comparator)
  LEFT JOIN pl ON pl.subject_id = w.subject_id AND pl.comparator = w.comparator AND dst_ml IS NOT NULL
  LEFT JOIN rf USING (patient_id)"""),
       rounded=["src_volume_ml", "dst_volume_ml", "volume_ml", "fraction_inside_brain"])
def a32_registration(spark, folder):
    """Comparator maps before (``ref``) and after (``pred``, where one comparator loses a
    label); some transforms left no file."""
    number = F.col("subject_id").cast("int")
    who = [F.floor(number / 10).cast("int").alias("patient_id"), (number % 10).alias("timepoint")]
    kinds = F.explode(F.array(F.lit("hdglio"), F.lit("deepbratumia"))).alias("comparator")
    lost = (F.col("comparator") == "hdglio") & (F.col("_k") % 8 == 5)
    size = F.aggregate("voxel_size_mm", F.lit(1.0), lambda a, v: a * v) / 1000.0
    expected = b.grids(spark, folder).select(*who, kinds, number.alias("_k"), size.alias("src_ml")).withColumn(
        "dst_ml", F.when(~lost, F.lit(0.001))).drop("_k")
    voxels = b.volumes(spark, folder).select(*who, "x", "y", "z", "pred", "ref", kinds)
    source = voxels.where("ref > 0").withColumn("label", F.col("ref"))
    merged = (F.col("comparator") == "hdglio") & (F.col("pred") == 4)
    target = voxels.where("pred > 0").withColumn("label", F.when(merged, 2).otherwise(F.col("pred")))
    reference = visits(spark, folder).where("timepoint = 0 AND channel = 'T1'")
    return ops.registration_coverage(expected, source, target, reference)
