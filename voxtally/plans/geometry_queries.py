"""Surfaces, distances and placement over the ``volumes`` and ``grids`` views."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtally.functions import numbers
from voxtally.operators import geometry as ops
from voxtally.plans import bindings as b
from voxtally.plans.bindings import COMPARTMENTS_SQL, VOLUMES_SQL, sql_masked, with_ctes
from voxtally.plans.registry import query

SURFACE_SQL = f"""
fg AS (
  SELECT subject_id, compartment, side, x, y, z FROM (
    SELECT subject_id, compartment, 'pred' AS side, x, y, z FROM volumes, comps WHERE {sql_masked('pred')}
    UNION ALL
    SELECT subject_id, compartment, 'ref', x, y, z FROM volumes, comps WHERE {sql_masked('ref')})),
inner_ AS (
  SELECT f.subject_id, f.compartment, f.side, f.x, f.y, f.z FROM fg f
  JOIN fg n ON n.subject_id = f.subject_id AND n.compartment = f.compartment AND n.side = f.side
    AND ((n.x BETWEEN f.x - 1 AND f.x + 1 AND n.y = f.y AND n.z = f.z AND n.x <> f.x))
  GROUP BY ALL HAVING count(*) = 2),
inner2 AS (
  SELECT i.* FROM inner_ i JOIN fg n ON n.subject_id = i.subject_id AND n.compartment = i.compartment
    AND n.side = i.side AND n.x = i.x AND n.z = i.z AND n.y BETWEEN i.y - 1 AND i.y + 1 AND n.y <> i.y
  GROUP BY ALL HAVING count(*) = 2),
inner3 AS (
  SELECT i.* FROM inner2 i JOIN fg n ON n.subject_id = i.subject_id AND n.compartment = i.compartment
    AND n.side = i.side AND n.x = i.x AND n.y = i.y AND n.z BETWEEN i.z - 1 AND i.z + 1 AND n.z <> i.z
  GROUP BY ALL HAVING count(*) = 2),
surface AS (
  SELECT * FROM fg EXCEPT SELECT * FROM inner3)"""
NEAREST_SQL = """
nearest AS (
  SELECT q.subject_id, q.compartment, q.side, q.x, q.y, q.z,
    sqrt(min(pow((q.x - t.x) * sx, 2) + pow((q.y - t.y) * sy, 2) + pow((q.z - t.z) * sz, 2))) AS distance_mm
  FROM surface q JOIN surface t ON t.subject_id = q.subject_id AND t.compartment = q.compartment
    AND t.side <> q.side
  JOIN grids g ON g.subject_id = q.subject_id GROUP BY ALL)"""


def hausdorff_sql(p: float) -> str:
    return f"""
hd AS (
  SELECT subject_id, compartment, max(d) AS d FROM (
    SELECT subject_id, compartment, side, quantile_cont(distance_mm, {p}) AS d FROM nearest GROUP BY ALL)
  GROUP BY 1, 2),
sizes AS (
  SELECT subject_id, compartment, count(*) FILTER (WHERE side = 'pred') AS n_pred,
         count(*) FILTER (WHERE side = 'ref') AS n_ref
  FROM fg GROUP BY 1, 2),
hausdorff AS (
  SELECT subject_id, compartment, CASE
      WHEN coalesce(n_pred, 0) = 0 AND coalesce(n_ref, 0) = 0 THEN NULL
      WHEN coalesce(n_pred, 0) = 0 OR coalesce(n_ref, 0) = 0 THEN 'inf'::DOUBLE ELSE d END AS hausdorff_mm
  FROM (SELECT subject_id, compartment FROM grids, comps) LEFT JOIN sizes USING (subject_id, compartment)
    LEFT JOIN hd USING (subject_id, compartment))"""


BASE = (VOLUMES_SQL, COMPARTMENTS_SQL, SURFACE_SQL)


@query("j11_surface_voxels", with_ctes(*BASE, select="SELECT * FROM surface"))
def j11(spark, folder):
    return ops.paired_surfaces(b.volumes(spark, folder))


@query("j12_nearest_surface", with_ctes(*BASE, NEAREST_SQL, select="SELECT * FROM nearest"),
       rounded=["distance_mm"])
def j12(spark, folder):
    return ops.nearest_surface(
        ops.paired_surfaces(b.volumes(spark, folder)), b.grids(spark, folder))


@query("a10_hausdorff95", with_ctes(*BASE, NEAREST_SQL, hausdorff_sql(0.95), select="SELECT * FROM hausdorff"),
       rounded=["hausdorff_mm"])
def a10(spark, folder):
    return ops.hausdorff(b.volumes(spark, folder), b.grids(spark, folder))


@query("a10_hausdorff100", with_ctes(*BASE, NEAREST_SQL, hausdorff_sql(1.0), select="SELECT * FROM hausdorff"),
       rounded=["hausdorff_mm"])
def a10_classical(spark, folder):
    return ops.hausdorff(b.volumes(spark, folder), b.grids(spark, folder), percentile=100.0)


@query("a11_paired_metrics", with_ctes(*BASE, NEAREST_SQL, hausdorff_sql(0.95), f"""
c AS (
  SELECT subject_id, compartment, count(*) FILTER (WHERE {sql_masked('pred')}) AS p,
         count(*) FILTER (WHERE {sql_masked('ref')}) AS g,
         count(*) FILTER (WHERE ({sql_masked('pred')}) AND ({sql_masked('ref')})) AS i
  FROM volumes, comps GROUP BY 1, 2)""", select="""
SELECT subject_id, compartment, CASE WHEN p + g > 0 THEN 2.0::DOUBLE * i / (p + g) END AS dice,
  hausdorff_mm AS hd95_mm, abs((p - g) * (sx * sy * sz)) AS abs_volumetric_error_mm3,
  CASE WHEN g > 0 THEN 1.0::DOUBLE * i / g END AS sensitivity,
  1.0::DOUBLE * (13824 - p - g + i) / (13824 - g) AS specificity
FROM c JOIN hausdorff USING (subject_id, compartment) JOIN grids USING (subject_id)"""),
       rounded=["dice", "hd95_mm", "abs_volumetric_error_mm3", "sensitivity", "specificity"])
def a11(spark, folder):
    grids = b.grids(spark, folder).withColumn(
        "voxel_volume_mm3", numbers.voxel_volume_mm3(F.col("affine")))
    return ops.paired_metrics(b.volumes(spark, folder), grids)


@query("p19_affine_geometry", with_ctes(VOLUMES_SQL, select="""
SELECT subject_id, sx * sy * sz AS voxel_volume_mm3, sx AS spacing_x, sy AS spacing_y, sz AS spacing_z
FROM grids"""), rounded=["voxel_volume_mm3", "spacing_x", "spacing_y", "spacing_z"])
def p19(spark, folder):
    affine = F.col("affine")
    spacing = numbers.voxel_spacing_mm(affine)
    return b.grids(spark, folder).select(
        "subject_id", numbers.voxel_volume_mm3(affine).alias("voxel_volume_mm3"),
        *[s.alias(f"spacing_{a}") for s, a in zip(spacing, "xyz")])


def transforms(spark, folder):
    """Permutation and flips per subject: x from old z, y flipped, z from old x flipped."""
    odd = F.col("s_suppkey") % 2 == 1
    pick = lambda a, c: F.when(odd, F.array(*map(F.lit, a))).otherwise(F.array(*map(F.lit, c)))
    return b.table(spark, folder, "supplier").select(
        b._subject(F.col("s_suppkey")).alias("subject_id"),
        F.array(*[F.lit(b.SHAPE)] * 3).alias("shape"),
        pick((2, 1, 0), (0, 1, 2)).alias("source"), pick((1, -1, -1), (-1, -1, 1)).alias("flip"))


@query("p20_voxel_reorientation", with_ctes(VOLUMES_SQL, select="""
SELECT subject_id, CASE WHEN odd THEN z ELSE 23 - x END AS x, 23 - y AS y,
       CASE WHEN odd THEN 23 - x ELSE z END AS z
FROM (SELECT *, CAST(subject_id AS INTEGER) % 2 = 1 AS odd FROM volumes)"""))
def p20(spark, folder):
    moved = ops.reoriented(b.volumes(spark, folder), transforms(spark, folder))
    return moved.select("subject_id", "x", "y", "z")


@query("p21_volume_reorientation", with_ctes(VOLUMES_SQL, select="""
SELECT subject_id, CASE WHEN odd THEN z ELSE 23 - x END AS x, 23 - y AS y,
       CASE WHEN odd THEN 23 - x ELSE z END AS z, pred, ref
FROM (SELECT *, CAST(subject_id AS INTEGER) % 2 = 1 AS odd FROM volumes)"""))
def p21(spark, folder):
    return ops.reoriented(b.volumes(spark, folder), transforms(spark, folder))


@query("p29_display_slice", with_ctes(VOLUMES_SQL, select="""
SELECT subject_id, z, 23 - y AS row, 23 - x AS col, pred FROM volumes
WHERE z = 10 + CAST(subject_id AS INTEGER) % 3"""))
def p29(spark, folder):
    planes = b.grids(spark, folder).select(
        "subject_id", (10 + F.col("subject_id").cast("int") % 3).alias("z"))
    cut = ops.display_slice(b.volumes(spark, folder), planes, b.grids(spark, folder))
    return cut.select("subject_id", "z", "row", "col", "pred")


CENTROID_SQL = """
cen AS (
  SELECT g.subject_id, coalesce(mx, nx // 2) AS x, coalesce(my, ny // 2) AS y, coalesce(mz, nz // 2) AS z
  FROM grids g LEFT JOIN (
    SELECT subject_id, CAST(round_even(avg(x), 0) AS INTEGER) AS mx, CAST(round_even(avg(y), 0) AS INTEGER) AS my,
           CAST(round_even(avg(z), 0) AS INTEGER) AS mz FROM volumes WHERE {} GROUP BY 1) USING (subject_id))"""


@query("a38_tumor_centroid", with_ctes(VOLUMES_SQL, CENTROID_SQL.format("pred = 4"), select="SELECT * FROM cen"))
def a38(spark, folder):
    return ops.centroids(b.volumes(spark, folder), b.grids(spark, folder), F.col("pred") == 4)


@query("j15_flagged_slices", with_ctes(VOLUMES_SQL, CENTROID_SQL.format("pred <> 0"), """
flagged AS (SELECT subject_id FROM volumes GROUP BY 1
            HAVING 2.0::DOUBLE * count(*) FILTER (WHERE pred > 0 AND ref > 0)
                   / (count(*) FILTER (WHERE pred > 0) + count(*) FILTER (WHERE ref > 0)) < 0.85)""",
       select="""
SELECT v.subject_id, v.z, 23 - v.y AS row, 23 - v.x AS col, pred, ref
FROM volumes v JOIN cen ON cen.subject_id = v.subject_id AND cen.z = v.z
WHERE v.subject_id IN (SELECT subject_id FROM flagged)"""))
def j15(spark, folder):
    voxels, grids = b.volumes(spark, folder), b.grids(spark, folder)
    scored = ops.overlap_metrics(ops.confusion_counts(voxels, grids=grids))
    flagged = scored.where((F.col("compartment") == "WT") & (F.col("dice") < 0.85))
    centre = ops.centroids(voxels, grids, F.col("pred") != 0)
    return ops.flagged_slices(voxels, flagged, centre, grids).select(
        "subject_id", "z", "row", "col", "pred", "ref")


@query("a40_best_slice", with_ctes(VOLUMES_SQL, """
shp AS (SELECT subject_id, CASE WHEN CAST(subject_id AS INTEGER) % 2 = 0 THEN 0 ELSE 2 END AS axis, 20 AS n FROM grids),
pl AS (SELECT v.subject_id, CASE axis WHEN 0 THEN x ELSE z END AS plane, count(*) AS voxels
       FROM volumes v JOIN shp USING (subject_id) WHERE ref = 4 GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY voxels DESC, plane) AS rn FROM pl)
         WHERE rn = 1)""", select="""
SELECT subject_id, axis, coalesce(plane, n // 2) AS plane, coalesce(voxels, 0) AS voxels
FROM shp LEFT JOIN best USING (subject_id)"""))
def a40(spark, folder):
    even = F.col("subject_id").cast("int") % 2 == 0
    shapes = b.grids(spark, folder).select("subject_id", F.when(
        even, F.array(F.lit(20), F.lit(24), F.lit(24))
    ).otherwise(F.array(F.lit(24), F.lit(24), F.lit(20))).alias("shape"))
    return ops.best_slices(b.volumes(spark, folder), shapes, F.col("ref") == 4)


@query("p4_two_stage_remap", with_ctes(VOLUMES_SQL, select="""
SELECT subject_id, x, y, z, CASE WHEN whole <> 18 THEN 0 WHEN inn = 2 THEN 4 WHEN inn = 1 THEN 2
       WHEN inn = 3 THEN 1 ELSE 2 END AS label
FROM (SELECT *, CASE WHEN ref > 0 THEN 18 ELSE 0 END AS whole,
        CASE pred WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS inn FROM volumes)"""))
def p4(spark, folder):
    voxels = b.volumes(spark, folder)
    keys = ["subject_id", "x", "y", "z"]
    whole = voxels.select(*keys, F.when(F.col("ref") > 0, 18).otherwise(0).alias("whole"))
    inner = voxels.where("pred > 0").select(*keys, F.when(F.col("pred") == 1, 3).when(
        F.col("pred") == 2, 1).otherwise(2).alias("inner"))
    return ops.two_stage_map(whole, inner)
