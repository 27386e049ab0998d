"""Agreement of two label maps, region tables and raw codes over the ``cells`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtally.functions import agreement as stat
from voxtally.operators import agreement
from voxtally.plans import bindings as b
from voxtally.plans.bindings import (
    CELLS_SQL,
    COMPARTMENTS_SQL,
    LUT_SQL,
    VOLUMES_SQL,
    matrix_sql,
    sql_masked,
    with_ctes,
)
from voxtally.plans.region_queries import matrix
from voxtally.plans.registry import query
from voxtally.session import run_folder
from voxtally.sources.stored_voxels import store_voxels

COUNTS_SQL = f"""
counts AS (
  SELECT subject_id, compartment,
         count(*) FILTER (WHERE {sql_masked('pred')}) AS n_pred,
         count(*) FILTER (WHERE {sql_masked('ref')}) AS n_ref,
         count(*) FILTER (WHERE ({sql_masked('pred')}) AND ({sql_masked('ref')})) AS n_both,
         count(*) AS n_grid
  FROM cells, comps GROUP BY 1, 2)"""


def counts(spark, folder):
    return agreement.confusion_counts(b.cells(spark, folder))


def metric(name: str, expression: str, column):
    sql = with_ctes(CELLS_SQL, COMPARTMENTS_SQL, COUNTS_SQL, select=f"""
SELECT subject_id, compartment, {expression} FROM counts""")

    def run(spark, folder):
        scored = agreement.overlap_metrics(counts(spark, folder), 1.5)
        return scored.select("subject_id", "compartment", *column)

    query(name, sql, rounded=column)(run)


@query("a4_confusion_counts", with_ctes(CELLS_SQL, COMPARTMENTS_SQL, COUNTS_SQL, select="""
SELECT subject_id, compartment, n_pred, n_ref, n_both, n_grid FROM counts"""))
def a4(spark, folder):
    return counts(spark, folder)


metric("a5_dice", "CASE WHEN n_pred + n_ref > 0 THEN 2.0::DOUBLE * n_both / (n_pred + n_ref) END AS dice",
       ["dice"])
metric("a6_jaccard", """CASE WHEN n_pred + n_ref - n_both > 0
       THEN 1.0::DOUBLE * n_both / (n_pred + n_ref - n_both) END AS jaccard""", ["jaccard"])
metric("a7_sensitivity", "CASE WHEN n_ref > 0 THEN 1.0::DOUBLE * n_both / n_ref END AS sensitivity",
       ["sensitivity"])
metric("a8_specificity", """CASE WHEN n_grid > n_ref
       THEN 1.0::DOUBLE * (n_grid - n_pred - n_ref + n_both) / (n_grid - n_ref) END AS specificity""",
       ["specificity"])
metric("a9_volumetric_error", """(n_pred - n_ref) * 1.5::DOUBLE AS volumetric_error_mm3,
       abs((n_pred - n_ref) * 1.5::DOUBLE) AS abs_volumetric_error_mm3""",
       ["volumetric_error_mm3", "abs_volumetric_error_mm3"])


@query("a4_sparse_confusion_counts", with_ctes(VOLUMES_SQL, COMPARTMENTS_SQL, f"""
c AS (
  SELECT subject_id, compartment,
         count(*) FILTER (WHERE {sql_masked('pred')}) AS p,
         count(*) FILTER (WHERE {sql_masked('ref')}) AS g,
         count(*) FILTER (WHERE ({sql_masked('pred')}) AND ({sql_masked('ref')})) AS both_
  FROM volumes, comps GROUP BY 1, 2)""", select="""
SELECT subject_id, compartment, coalesce(p, 0) AS n_pred, coalesce(g, 0) AS n_ref,
       coalesce(both_, 0) AS n_both, CAST(nx AS BIGINT) * ny * nz AS n_grid,
       1.0::DOUBLE * (CAST(nx AS BIGINT) * ny * nz - p - g + both_)
         / (CAST(nx AS BIGINT) * ny * nz - g) AS specificity
FROM (SELECT * FROM grids, comps) LEFT JOIN c USING (subject_id, compartment)"""),
       rounded=["specificity"])
def a4_sparse(spark, folder):
    sparse = agreement.confusion_counts(
        b.volumes(spark, folder), grids=b.grids(spark, folder))
    return agreement.overlap_metrics(sparse).select(
        "subject_id", "compartment", "n_pred", "n_ref", "n_both", "n_grid", "specificity")


@query("a4_label_agreement", """
WITH c AS (SELECT count(*) FILTER (WHERE quality = 1) AS n_pred, count(*) FILTER (WHERE toxic = 1) AS n_ref,
             count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS n_both, count(*) AS n_grid FROM labels)
SELECT n_pred, n_ref, n_both, n_grid, 2.0::DOUBLE * n_both / (n_pred + n_ref) AS dice,
       1.0::DOUBLE * n_both / n_ref AS sensitivity,
       1.0::DOUBLE * (n_grid - n_pred - n_ref + n_both) / (n_grid - n_ref) AS specificity FROM c""",
       rounded=["dice", "sensitivity", "specificity"])
def a4_labels(spark, folder):
    quality, toxic = F.col("quality") == 1, F.col("toxic") == 1
    marks = b.table(spark, folder, "labels").agg(
        F.count_if(quality).alias("n_pred"), F.count_if(toxic).alias("n_ref"),
        F.count_if(quality & toxic).alias("n_both"), F.count(F.lit(1)).alias("n_grid"))
    return agreement.overlap_metrics(marks).select(
        "n_pred", "n_ref", "n_both", "n_grid", "dice", "sensitivity", "specificity")


@query("j2_aligned_pair", with_ctes(VOLUMES_SQL, select="""
SELECT subject_id, x, y, z, pred, ref FROM volumes"""))
def j2(spark, folder):
    voxels = b.volumes(spark, folder)
    keys = ["subject_id", "x", "y", "z"]
    pred = voxels.where("pred > 0").select(*keys, F.col("pred").alias("label"))
    ref = voxels.where("ref > 0").select(*keys, F.col("ref").alias("label"))
    grid = b.grids(spark, folder).select("subject_id", "shape")
    return agreement.aligned_pair(pred, ref, grid)


def stored_maps(spark, folder):
    """Both label maps as sparse voxel tables, stored in the same buckets."""
    path, voxels = run_folder(spark, "label-maps"), b.volumes(spark, folder)
    return [
        store_voxels(voxels.where(F.col(side) > 0).select("subject_id", "x", "y", "z", F.col(side).alias("label")),
                     f"{path}/{side}")
        for side in ("pred", "ref")]


@query("j2_stored_pair", with_ctes(VOLUMES_SQL, select="""
SELECT subject_id, x, y, z, pred, ref FROM volumes"""))
def j2_stored(spark, folder):
    return agreement.aligned_pair(*stored_maps(spark, folder), b.grids(spark, folder).select("subject_id", "shape"))


PAIRS_SQL = """
pairs AS (
  SELECT subject_id, label, compartment, p.pct_of_parcel AS pct_pred, r.pct_of_parcel AS pct_ref,
         p.overlap_volume_mm3 AS vol_pred, r.overlap_volume_mm3 AS vol_ref,
         p.pct_of_parcel - r.pct_of_parcel AS diff_pct,
         0.5::DOUBLE * (p.pct_of_parcel + r.pct_of_parcel) AS mean_pct,
         abs(p.overlap_volume_mm3 - r.overlap_volume_mm3) AS abs_diff_volume_mm3
  FROM mp p JOIN mr r USING (subject_id, label, compartment)
  WHERE p.pct_of_parcel IS NOT NULL AND r.pct_of_parcel IS NOT NULL)"""
PAIR_CTES = (CELLS_SQL, LUT_SQL, matrix_sql("mp", "pred"), matrix_sql("mr", "ref"), PAIRS_SQL)
PAIR_DOUBLES = ["pct_pred", "pct_ref", "vol_pred", "vol_ref", "diff_pct", "mean_pct",
                "abs_diff_volume_mm3"]


def pairs(spark, folder):
    return agreement.region_pairs(matrix(spark, folder, "pred"), matrix(spark, folder, "ref"))


@query("j4_agreement_join", with_ctes(*PAIR_CTES, select="""
SELECT subject_id, label, compartment, pct_pred, pct_ref, vol_pred, vol_ref FROM pairs"""),
       rounded=PAIR_DOUBLES[:4])
def j4(spark, folder):
    return pairs(spark, folder).select("subject_id", "label", "compartment", *PAIR_DOUBLES[:4])


@query("j4_agreement_problems", with_ctes(CELLS_SQL, LUT_SQL, matrix_sql("mp", "pred"),
       matrix_sql("mr", "ref"), """
p AS (SELECT * FROM mp WHERE CAST(subject_id AS INTEGER) % 7 <> 0),
r AS (SELECT subject_id, CASE WHEN CAST(subject_id AS INTEGER) % 7 = 2 THEN label + 1000 ELSE label END AS label,
             compartment, CASE WHEN CAST(subject_id AS INTEGER) % 7 = 3 THEN NULL ELSE pct_of_parcel END AS pct
      FROM mr WHERE CAST(subject_id AS INTEGER) % 7 <> 1),
u AS (SELECT subject_id, count(*) FILTER (WHERE pct IS NOT NULL AND pct_of_parcel IS NOT NULL) AS usable
      FROM p JOIN r USING (subject_id, label, compartment) GROUP BY 1)""", select="""
SELECT subject_id, reason FROM (
  SELECT subject_id, CASE
    WHEN subject_id NOT IN (SELECT subject_id FROM p) THEN 'prediction table not found'
    WHEN subject_id NOT IN (SELECT subject_id FROM r) THEN 'reference table not found'
    WHEN usable IS NULL THEN 'empty join' WHEN usable = 0 THEN 'all pairs missing' END AS reason
  FROM (SELECT DISTINCT subject_id FROM cells) LEFT JOIN u USING (subject_id))
WHERE reason IS NOT NULL"""))
def j4_problems(spark, folder):
    group = F.col("subject_id").cast("int") % 7
    pred = matrix(spark, folder, "pred").where(group != 0)
    ref = matrix(spark, folder, "ref").where(group != 1).withColumns({
        "label": F.when(group == 2, F.col("label") + 1000).otherwise(F.col("label")),
        "pct_of_parcel": F.when(group != 3, F.col("pct_of_parcel")),
    })
    return agreement.pair_problems(b.cells(spark, folder), pred, ref)


@query("a14_pair_differences", with_ctes(*PAIR_CTES, select="SELECT * FROM pairs"), rounded=PAIR_DOUBLES)
def a14(spark, folder):
    return pairs(spark, folder)


@query("a12_concordance", with_ctes(*PAIR_CTES, select="""
SELECT compartment, CASE WHEN count(*) >= 2 THEN 2 * covar_pop(pct_pred, pct_ref)
  / nullif(var_pop(pct_pred) + var_pop(pct_ref) + pow(avg(pct_pred) - avg(pct_ref), 2), 0) END AS ccc
FROM pairs GROUP BY 1"""), rounded=["ccc"])
def a12(spark, folder):
    return pairs(spark, folder).groupBy("compartment").agg(
        stat.concordance(F.col("pct_pred"), F.col("pct_ref")).alias("ccc"))


LOA_DOUBLES = ["ccc", "mean_diff_pct", "std_diff_pct", "loa_lower_pct", "loa_upper_pct",
               "mean_abs_diff_volume_mm3"]


@query("a13_limits_of_agreement", with_ctes(COMPARTMENTS_SQL, *PAIR_CTES, """
s AS (SELECT compartment, 2 * covar_pop(pct_pred, pct_ref)
      / nullif(var_pop(pct_pred) + var_pop(pct_ref) + pow(avg(pct_pred) - avg(pct_ref), 2), 0) AS ccc,
    avg(diff_pct) AS mean_diff_pct, stddev_samp(diff_pct) AS std_diff_pct,
    avg(diff_pct) - 1.96::DOUBLE * stddev_samp(diff_pct) AS loa_lower_pct,
    avg(diff_pct) + 1.96::DOUBLE * stddev_samp(diff_pct) AS loa_upper_pct,
    avg(abs_diff_volume_mm3) AS mean_abs_diff_volume_mm3, count(*) AS n_pairs,
    count(DISTINCT subject_id) AS n_subjects, count(DISTINCT label) AS n_regions
  FROM pairs GROUP BY 1)""", select="""
SELECT compartment, ccc, mean_diff_pct, std_diff_pct, loa_lower_pct, loa_upper_pct,
       mean_abs_diff_volume_mm3, coalesce(n_pairs, 0) AS n_pairs,
       coalesce(n_subjects, 0) AS n_subjects, coalesce(n_regions, 0) AS n_regions
FROM comps LEFT JOIN s USING (compartment)"""), rounded=LOA_DOUBLES)
def a13(spark, folder):
    return agreement.limits_of_agreement(pairs(spark, folder))


RESIDUAL_SQL = """
each AS (SELECT subject_id, avg(abs_diff_volume_mm3) AS mean_abs_residual FROM pairs GROUP BY 1)"""


@query("a37_subject_residuals", with_ctes(*PAIR_CTES, RESIDUAL_SQL, select="""
SELECT subject_id, mean_abs_residual, (SELECT avg(mean_abs_residual) FROM each) AS cohort_mean
FROM each"""), rounded=["mean_abs_residual", "cohort_mean"])
def a37(spark, folder):
    cells = pairs(spark, folder)
    return agreement.subject_residuals(cells).withColumn(
        "cohort_mean", agreement.cohort_residual(cells).scalar())


@query("w6_representative_subjects", with_ctes(*PAIR_CTES, RESIDUAL_SQL, select="""
SELECT subject_id, mean_abs_residual,
       abs(mean_abs_residual - (SELECT avg(mean_abs_residual) FROM each)) AS distance
FROM each ORDER BY distance, subject_id LIMIT 5"""), rounded=["mean_abs_residual", "distance"])
def w6(spark, folder):
    return agreement.representative_subjects(pairs(spark, folder), 5)


COMPARATOR_SQL = """
k(kind, compartment, code) AS (VALUES ('hdglio','WT',1), ('hdglio','WT',2), ('hdglio','ET',2),
  ('deepbratumia','WT',1), ('deepbratumia','WT',2), ('deepbratumia','WT',3),
  ('deepbratumia','TC',1), ('deepbratumia','TC',2), ('deepbratumia','ET',1)),
kc AS (SELECT kind, compartment, list(code) AS codes FROM k GROUP BY 1, 2),
t AS (
  SELECT subject_id, timepoint, kind, compartment, count(*) FILTER (WHERE ours) AS p,
         count(*) FILTER (WHERE theirs) AS g, count(*) FILTER (WHERE ours AND theirs) AS i
  FROM (SELECT subject_id, timepoint, kind, compartment, list_contains(codes, raw) AS theirs,
          CASE compartment WHEN 'WT' THEN pred IN (1,2,4) WHEN 'TC' THEN pred IN (1,4) ELSE pred = 4 END AS ours
        FROM cells, kc) GROUP BY 1, 2, 3, 4)"""
COMPARATOR_SELECT = """
SELECT subject_id, timepoint, kind, compartment,
       CASE WHEN p + g > 0 THEN 2.0::DOUBLE * i / (p + g) END AS dice,
       CASE WHEN p + g - i > 0 THEN 1.0::DOUBLE * i / (p + g - i) END AS jaccard,
       p * 0.001::DOUBLE AS vol_pred_ml, g * 0.001::DOUBLE AS vol_comparator_ml,
       p * 0.001::DOUBLE - g * 0.001::DOUBLE AS vol_diff_ml FROM t"""
COMPARATOR_DOUBLES = ["dice", "jaccard", "vol_pred_ml", "vol_comparator_ml", "vol_diff_ml"]


@query("a29_comparator_agreement", with_ctes(CELLS_SQL, COMPARATOR_SQL, select=COMPARATOR_SELECT),
       rounded=COMPARATOR_DOUBLES)
def a29(spark, folder):
    return agreement.comparator_agreement(
        b.cells(spark, folder), keys=["subject_id", "timepoint"],
        comparators={"hdglio": "raw", "deepbratumia": "raw"})


@query("a29_comparator_agreement_voxel_sizes", with_ctes(CELLS_SQL, COMPARATOR_SQL, select=COMPARATOR_SELECT.replace(
    "0.001::DOUBLE", "(0.001::DOUBLE * (1 + CAST(subject_id AS INTEGER) % 3 * 0.25))")), rounded=COMPARATOR_DOUBLES)
def a29_voxel_sizes(spark, folder):
    return agreement.comparator_agreement(
        b.cells(spark, folder), keys=["subject_id", "timepoint"],
        comparators={"hdglio": "raw", "deepbratumia": "raw"},
        voxel_mm3=F.lit(1.0) + F.col("subject_id").cast("int") % 3 * F.lit(0.25))


@query("a29_checked_comparators", with_ctes(VOLUMES_SQL, COMPARTMENTS_SQL, COMPARATOR_SQL.split("t AS (")[0].rstrip().rstrip(","), """
files AS (
  SELECT subject_id, CAST(subject_id AS INTEGER) AS s, kind, sx * sy * sz / 1000.0::DOUBLE AS ml,
         CASE WHEN kind = 'hdglio' AND CAST(subject_id AS INTEGER) % 6 = 4 THEN 20 ELSE 24 END AS cx
  FROM grids, (VALUES ('hdglio'), ('deepbratumia')) AS v(kind)
  WHERE NOT (kind = 'deepbratumia' AND CAST(subject_id AS INTEGER) % 8 = 5)),
v AS (SELECT f.subject_id, f.kind, kc.compartment, any_value(f.ml) AS ml,
        count(*) FILTER (WHERE ours) AS p, count(*) FILTER (WHERE list_contains(codes, ref % 3 + (ref > 0)::INTEGER)) AS g,
        count(*) FILTER (WHERE ours AND list_contains(codes, ref % 3 + (ref > 0)::INTEGER)) AS i
      FROM files f JOIN kc USING (kind) LEFT JOIN (
        SELECT subject_id, ref, compartment,
          CASE compartment WHEN 'WT' THEN pred IN (1,2,4) WHEN 'TC' THEN pred IN (1,4) ELSE pred = 4 END AS ours
        FROM volumes, comps) x ON x.subject_id = f.subject_id AND x.compartment = kc.compartment
      WHERE cx = 24 GROUP BY ALL)""", select="""
SELECT subject_id, kind, 'shape mismatch' AS status, '24x24x24' AS ref_shape, '20x24x24' AS comparator_shape,
       NULL AS compartment, NULL::DOUBLE AS dice, NULL::DOUBLE AS jaccard, NULL::DOUBLE AS vol_pred_ml,
       NULL::DOUBLE AS vol_comparator_ml, NULL::DOUBLE AS vol_diff_ml FROM files WHERE cx <> 24
UNION ALL
SELECT subject_id, kind, 'ok', '24x24x24', '24x24x24', compartment,
       CASE WHEN p + g > 0 THEN 2.0::DOUBLE * i / (p + g) END, CASE WHEN p + g - i > 0 THEN 1.0::DOUBLE * i / (p + g - i) END,
       p * ml, g * ml, p * ml - g * ml FROM v"""), rounded=COMPARATOR_DOUBLES)
def a29_checked(spark, folder):
    """Comparator maps in files of their own: some absent, some of another shape."""
    voxels, number = b.volumes(spark, folder), F.col("subject_id").cast("int")
    ours = voxels.where("pred > 0").select("subject_id", "x", "y", "z", F.col("pred").alias("label"))
    code = F.col("ref") % 3 + F.when(F.col("ref") > 0, 1).otherwise(0)
    kinds = F.explode(F.array(F.lit("hdglio"), F.lit("deepbratumia")))
    absent = (F.col("kind") == "deepbratumia") & (number % 8 == 5)
    theirs = voxels.where("ref > 0").select(
        "subject_id", "x", "y", "z", code.alias("label"), kinds.alias("kind")).where(~absent)
    sizes = b.grids(spark, folder).withColumn(
        "voxel_mm3", F.aggregate("voxel_size_mm", F.lit(1.0), lambda a, v: a * v))
    other = sizes.withColumn("kind", kinds).where(~absent)
    first = F.when((F.col("kind") == "hdglio") & (number % 6 == 4), 20).otherwise(F.get("shape", F.lit(0)))
    grids = sizes.select("subject_id", F.lit("dl").alias("source"), "shape", "voxel_mm3").unionByName(other.select(
        "subject_id", F.col("kind").alias("source"), F.array(first, F.lit(24), F.lit(24)).alias("shape"), "voxel_mm3"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), "x").alias(c)
    return agreement.checked_comparator_agreement(ours, theirs, grids, keys=["subject_id"]).withColumns(
        {c: text(c) for c in ("ref_shape", "comparator_shape")})


CROSSWALK_SQL = """
grid AS (SELECT * FROM (SELECT DISTINCT subject_id FROM cells),
  (VALUES (1), (2), (3)) AS r(raw_label), (VALUES ('pred'), ('ref')) AS m(comparator),
  (VALUES ('NCR', 1, 0), ('ED', 2, 1), ('ET', 4, 2)) AS c(target_class, code, place)),
long AS (SELECT subject_id, raw, 'pred' AS comparator, pred AS label FROM cells
         UNION ALL SELECT subject_id, raw, 'ref', ref FROM cells),
cross_counts AS (SELECT subject_id, comparator, raw, label, count(*) AS n FROM long GROUP BY ALL),
crosswalk AS (
  SELECT g.subject_id, g.raw_label, g.comparator, g.target_class, g.place,
    CAST(coalesce(sum(n) FILTER (WHERE raw = raw_label AND label = code), 0) AS BIGINT) AS intersection_voxels,
    CAST(coalesce(sum(n) FILTER (WHERE raw = raw_label), 0) AS BIGINT) AS raw_label_voxels,
    CAST(coalesce(sum(n) FILTER (WHERE label = code), 0) AS BIGINT) AS target_voxels
  FROM grid g LEFT JOIN cross_counts c USING (subject_id, comparator) GROUP BY ALL),
scored AS (SELECT *, CASE WHEN raw_label_voxels + target_voxels > 0
  THEN 2.0::DOUBLE * intersection_voxels / (raw_label_voxels + target_voxels) END AS dice FROM crosswalk),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, raw_label, comparator
  ORDER BY coalesce(dice, -1) DESC, intersection_voxels DESC, place) AS rn FROM scored) WHERE rn = 1)"""


def crosswalk(spark, folder):
    return agreement.raw_label_crosswalk(b.cells(spark, folder))


@query("a34_raw_label_crosswalk", with_ctes(CELLS_SQL, CROSSWALK_SQL, select="""
SELECT subject_id, raw_label, comparator, target_class, intersection_voxels, raw_label_voxels,
       target_voxels, dice FROM scored"""), rounded=["dice"])
def a34(spark, folder):
    return crosswalk(spark, folder)


@query("w5_best_match", with_ctes(CELLS_SQL, CROSSWALK_SQL, select="""
SELECT subject_id, raw_label, comparator, target_class AS best_target_class, dice AS best_dice,
       intersection_voxels, raw_label_voxels, target_voxels FROM best"""), rounded=["best_dice"])
def w5(spark, folder):
    return agreement.best_matches(crosswalk(spark, folder))


@query("a35_vote_counts", with_ctes(CELLS_SQL, CROSSWALK_SQL, select="""
SELECT raw_label, comparator, target_class AS best_target_class, count(*) AS votes
FROM best GROUP BY 1, 2, 3"""))
def a35(spark, folder):
    return agreement.vote_counts(agreement.best_matches(crosswalk(spark, folder)))


@query("u4_distinct_subjects", with_ctes(CELLS_SQL, select="SELECT DISTINCT subject_id FROM cells"))
def u4(spark, folder):
    return b.cells(spark, folder).select("subject_id").distinct()


@query("u1_union_of_sources", with_ctes(CELLS_SQL, LUT_SQL, matrix_sql("mp", "pred"), matrix_sql("mr", "ref"),
       select="""
SELECT 'dl' AS source, subject_id, label, compartment, overlap_voxels FROM mp
UNION ALL SELECT 'gt', subject_id, label, compartment, overlap_voxels FROM mr"""))
def u1(spark, folder):
    columns = ["subject_id", "label", "compartment", "overlap_voxels"]
    return matrix(spark, folder, "pred").select(F.lit("dl").alias("source"), *columns).unionByName(
        matrix(spark, folder, "ref").select(F.lit("gt").alias("source"), *columns))
