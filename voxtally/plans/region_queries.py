"""Region tables over the ``cells`` and ``volumes`` views."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtally.functions import labels, text
from voxtally.operators import regions
from voxtally.plans import bindings as b
from voxtally.plans.bindings import CELLS_SQL, LUT_SQL, matrix_sql, sql_in, with_ctes
from voxtally.plans.registry import query

MATRIX_DOUBLES = ("overlap_volume_mm3", "pct_of_parcel", "pct_of_compartment")


def matrix(spark, folder, label="pred", **options):
    return regions.region_matrix(
        b.cells(spark, folder), b.lut(spark), label=label, **options
    )


@query("p1_subregion_masks", with_ctes(CELLS_SQL, select=f"""
SELECT subject_id, region, pred, {sql_in('pred', 'WT')} AS wt, {sql_in('pred', 'TC')} AS tc,
       {sql_in('pred', 'ET')} AS et FROM cells"""))
def p1(spark, folder):
    cells = b.cells(spark, folder).select("subject_id", "region", "pred")
    return regions.subregion_masks(cells, "pred")


@query("p2_label_from_probabilities", with_ctes(CELLS_SQL, select="""
SELECT subject_id, region,
       CASE WHEN p_et > 0.25 THEN 4 WHEN p_tc > 0.25 THEN 1 WHEN p_wt > 0.25 THEN 2 ELSE 0 END
         AS label_low,
       CASE WHEN p_et > 0.5 THEN 4 WHEN p_tc > 0.5 THEN 1 WHEN p_wt > 0.5 THEN 2 ELSE 0 END AS label
FROM cells"""))
def p2(spark, folder):
    tc, wt, et = (F.get("p", F.lit(i)) for i in range(3))
    return b.cells(spark, folder).select(
        "subject_id", "region",
        labels.label_from_probabilities(tc, wt, et, 0.25).alias("label_low"),
        labels.label_from_probabilities(tc, wt, et).alias("label"),
    )


@query("p3_comparator_remap", with_ctes(CELLS_SQL, select="""
SELECT subject_id, region, raw, CASE raw WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 0 END AS from_hdglio,
       CASE raw WHEN 1 THEN 4 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS from_dbt FROM cells"""))
def p3(spark, folder):
    return b.cells(spark, folder).select(
        "subject_id", "region", "raw",
        labels.comparator_label(F.col("raw"), "hdglio").alias("from_hdglio"),
        labels.comparator_label(F.col("raw"), "dbt").alias("from_dbt"),
    )


@query("p5_comparator_compartments", with_ctes(CELLS_SQL, select="""
SELECT subject_id, kind, compartment, count(*) FILTER (WHERE raw = code) AS voxels
FROM cells, (VALUES ('hdglio','WT',1), ('hdglio','WT',2), ('hdglio','ET',2),
             ('deepbratumia','WT',1), ('deepbratumia','WT',2), ('deepbratumia','WT',3),
             ('deepbratumia','TC',1), ('deepbratumia','TC',2), ('deepbratumia','ET',1))
       AS k(kind, compartment, code)
GROUP BY ALL"""))
def p5(spark, folder):
    counts = []
    for kind in ("hdglio", "deepbratumia"):
        for comp in ("WT", "TC", "ET"):
            mask = labels.comparator_in_compartment(F.col("raw"), kind, comp)
            if mask is not None:
                counts.append((kind, comp, mask))
    wide = b.cells(spark, folder).groupBy("subject_id").agg(
        *[F.count_if(mask).alias(f"{kind}_{comp}") for kind, comp, mask in counts]
    )
    return wide.select("subject_id", F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(comp).alias("compartment"),
                 F.col(f"{kind}_{comp}").alias("voxels"))
        for kind, comp, _ in counts
    ])))


@query("p6_disjoint_volumes", with_ctes(CELLS_SQL, LUT_SQL, matrix_sql(), select="""
SELECT subject_id, label, max(overlap_volume_mm3) FILTER (WHERE compartment = 'ET') AS et_mm3,
  greatest(max(overlap_volume_mm3) FILTER (WHERE compartment = 'TC')
         - max(overlap_volume_mm3) FILTER (WHERE compartment = 'ET'), 0) AS ncr_mm3,
  greatest(max(overlap_volume_mm3) FILTER (WHERE compartment = 'WT')
         - max(overlap_volume_mm3) FILTER (WHERE compartment = 'TC'), 0) AS ed_mm3
FROM matrix GROUP BY 1, 2"""))
def p6(spark, folder):
    wide = matrix(spark, folder).groupBy("subject_id", "label").pivot(
        "compartment", ["WT", "TC", "ET"]).agg(F.max("overlap_volume_mm3"))
    parts = labels.disjoint_volumes(F.col("WT"), F.col("TC"), F.col("ET"))
    return wide.select("subject_id", "label", *[
        parts[c].alias(f"{c.lower()}_mm3") for c in ("NCR", "ED", "ET")])


@query("p7_compartment_scheme", with_ctes(CELLS_SQL, LUT_SQL, matrix_sql(), select="""
SELECT subject_id, CASE
  WHEN count(DISTINCT compartment) FILTER (WHERE compartment IN ('NCR','ED','ET')) = 3 THEN 'disjoint'
  WHEN count(DISTINCT compartment) FILTER (WHERE compartment IN ('WT','TC','ET')) = 3 THEN 'nested'
  ELSE 'unexpected' END AS scheme
FROM (SELECT subject_id,
        CASE WHEN CAST(subject_id AS INTEGER) % 3 = 0
             THEN CASE compartment WHEN 'WT' THEN 'NCR' WHEN 'TC' THEN 'ED' ELSE 'ET' END
             WHEN CAST(subject_id AS INTEGER) % 3 = 1 THEN compartment
             ELSE CASE compartment WHEN 'WT' THEN 'XX' ELSE compartment END END AS compartment
      FROM matrix) GROUP BY 1"""))
def p7(spark, folder):
    kind = F.col("subject_id").cast("int") % 3
    comp = F.col("compartment")
    mixed = matrix(spark, folder).withColumn(
        "compartment",
        F.when(kind == 0, F.when(comp == "WT", "NCR").when(comp == "TC", "ED").otherwise("ET"))
        .when(kind == 1, comp)
        .otherwise(F.when(comp == "WT", "XX").otherwise(comp)),
    )
    return regions.compartment_scheme(mixed)


STEM_SQL = "regexp_replace(trim(name), '^(ctx-lh-|ctx-rh-|wm-lh-|wm-rh-|Left-|Right-)', '')"
HEMI_SQL = """CASE WHEN regexp_matches(name, '^(ctx-lh-|wm-lh-|Left-)') THEN 'L'
     WHEN regexp_matches(name, '^(ctx-rh-|wm-rh-|Right-)') THEN 'R' END"""


def lobe_sql(stem: str) -> str:
    from voxtally.constants import CORTICAL_STEMS, SUBCORTICAL_NAMES

    whens = " ".join(
        f"WHEN {stem} IN ({', '.join(repr(s) for s in stems)}) THEN '{lobe}'"
        for group in (CORTICAL_STEMS, SUBCORTICAL_NAMES) for lobe, stems in group.items()
    )
    return f"CASE {whens} ELSE 'other' END"


NAMED_REGIONS_SQL = f"""
seen AS (SELECT DISTINCT region AS label FROM cells),
named AS (SELECT label, name, {STEM_SQL} AS stem, {HEMI_SQL} AS hemisphere
          FROM seen LEFT JOIN lut USING (label))"""


def named_regions(spark, folder):
    seen = b.cells(spark, folder).select(F.col("region").alias("label")).distinct()
    return seen.join(b.lut(spark), "label", "left")


@query("p12_hemisphere_prefix", with_ctes(CELLS_SQL, LUT_SQL, NAMED_REGIONS_SQL, select="""
SELECT label, name, stem, hemisphere FROM named"""))
def p12(spark, folder):
    return named_regions(spark, folder).select(
        "label", "name", text.stem(F.col("name")).alias("stem"),
        text.hemisphere(F.col("name")).alias("hemisphere"),
    )


@query("p13_lobe_of_region", with_ctes(CELLS_SQL, LUT_SQL, NAMED_REGIONS_SQL, select=f"""
SELECT label, name, {lobe_sql('stem')} AS lobe FROM named"""))
def p13(spark, folder):
    return named_regions(spark, folder).select(
        "label", "name", text.lobe(F.col("name")).alias("lobe"))


@query("a1_parcel_burden", with_ctes(CELLS_SQL, LUT_SQL, select="""
SELECT subject_id, label, name, parcel_voxels, tumor_voxels,
       100.0::DOUBLE * tumor_voxels / parcel_voxels AS pct_burden
FROM (SELECT subject_id, region AS label, count(*) AS parcel_voxels,
             count(*) FILTER (WHERE pred > 0) AS tumor_voxels FROM cells GROUP BY 1, 2)
JOIN lut USING (label)"""), rounded=["pct_burden"])
def a1(spark, folder):
    return regions.parcel_burden(b.cells(spark, folder), b.lut(spark), F.col("pred") > 0)


@query("a2_region_matrix", with_ctes(CELLS_SQL, LUT_SQL, matrix_sql(), select="SELECT * FROM matrix"),
       rounded=MATRIX_DOUBLES)
def a2(spark, folder):
    return matrix(spark, folder)


# A voxel size that differs by subject, as in scans of several machines.
SUBJECT_MM3_SQL = "(1.0::DOUBLE + CAST(subject_id AS INTEGER) % 3 * 0.25)"


def subject_mm3():
    return F.lit(1.0) + F.col("subject_id").cast("int") % 3 * F.lit(0.25)


@query("a2_region_matrix_voxel_sizes", with_ctes(CELLS_SQL, LUT_SQL, matrix_sql(), select=f"""
SELECT * REPLACE (overlap_voxels * {SUBJECT_MM3_SQL} AS overlap_volume_mm3) FROM matrix"""),
       rounded=MATRIX_DOUBLES)
def a2_voxel_sizes(spark, folder):
    cells = b.cells(spark, folder).withColumn("mm3", subject_mm3())
    return regions.region_matrix(cells, b.lut(spark), label="pred", voxel_mm3="mm3")


@query("a3_probabilistic_matrix", with_ctes(CELLS_SQL, LUT_SQL, """
sums AS (
  SELECT subject_id, region AS label, compartment, count(*) AS parcel_voxels,
         sum(p) AS m, sqrt(sum(p * (1 - p))) AS s
  FROM (SELECT subject_id, region, compartment,
               CASE compartment WHEN 'WT' THEN p_wt WHEN 'TC' THEN p_tc ELSE p_et END AS p
        FROM cells, (VALUES ('WT'), ('TC'), ('ET')) AS v(compartment))
  GROUP BY 1, 2, 3)""", select="""
SELECT subject_id, label, name, compartment, parcel_voxels,
       m AS overlap_voxels_mean, s AS overlap_voxels_std,
       m * 1.5::DOUBLE AS overlap_volume_mm3_mean, s * 1.5::DOUBLE AS overlap_volume_mm3_std,
       100.0::DOUBLE * m / parcel_voxels AS pct_of_parcel_mean,
       100.0::DOUBLE * s / parcel_voxels AS pct_of_parcel_std
FROM sums JOIN lut USING (label)"""),
       rounded=["overlap_voxels_mean", "overlap_voxels_std", "overlap_volume_mm3_mean",
                "overlap_volume_mm3_std", "pct_of_parcel_mean", "pct_of_parcel_std"])
def a3(spark, folder):
    return regions.probabilistic_region_matrix(
        b.cells(spark, folder), b.lut(spark), voxel_mm3=1.5)


@query("j3_parcel_lookup", with_ctes(CELLS_SQL, LUT_SQL, select="""
SELECT subject_id, label, name, parcel_voxels
FROM (SELECT subject_id, region AS label, count(*) AS parcel_voxels FROM cells GROUP BY 1, 2)
JOIN lut USING (label)"""))
def j3(spark, folder):
    return regions.parcel_burden(
        b.cells(spark, folder), b.lut(spark), F.col("pred") > 0
    ).select("subject_id", "label", "name", "parcel_voxels")


@query("a33_present_labels", with_ctes(CELLS_SQL, LUT_SQL, select="""
SELECT DISTINCT subject_id, label, name
FROM (SELECT subject_id, region AS label FROM cells) JOIN lut USING (label)"""))
def a33(spark, folder):
    return regions.present_labels(b.cells(spark, folder), b.lut(spark))


@query("w3_top_regions", with_ctes(CELLS_SQL, LUT_SQL, matrix_sql(), select="""
SELECT subject_id, compartment, label, name, pct_of_parcel, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY subject_id, compartment
                 ORDER BY pct_of_parcel DESC, label) AS INTEGER) AS rank FROM matrix)
WHERE rank <= 20"""), rounded=["pct_of_parcel"])
def w3(spark, folder):
    return regions.top_regions(matrix(spark, folder), 20).select(
        "subject_id", "compartment", "label", "name", "pct_of_parcel", "rank")


@query("o2_table_order", with_ctes(CELLS_SQL, LUT_SQL, matrix_sql(), select="""
SELECT compartment, subject_id, label, pct_of_parcel FROM matrix
ORDER BY compartment, pct_of_parcel DESC, subject_id, label"""), rounded=["pct_of_parcel"])
def o2(spark, folder):
    return regions.in_table_order(matrix(spark, folder)).select(
        "compartment", "subject_id", "label", "pct_of_parcel")


def wide_sql(name: str, matrix_name: str, keys: str = "subject_id, ") -> str:
    return f"""
{name}_v AS (
  SELECT {keys}name,
         coalesce(sum(overlap_volume_mm3) FILTER (WHERE compartment = 'WT'), 0) AS wt,
         coalesce(sum(overlap_volume_mm3) FILTER (WHERE compartment = 'TC'), 0) AS tc,
         coalesce(sum(overlap_volume_mm3) FILTER (WHERE compartment = 'ET'), 0) AS et
  FROM {matrix_name} WHERE label <> 0 GROUP BY ALL),
{name} AS (
  SELECT {keys}name, greatest(tc - et, 0) AS ncr, greatest(wt - tc, 0) AS ed, et,
         greatest(tc - et, 0) + greatest(wt - tc, 0) + et AS total_mm3
  FROM {name}_v WHERE greatest(tc - et, 0) + greatest(wt - tc, 0) + et > 0)"""


@query("v1_region_by_compartment", with_ctes(CELLS_SQL, LUT_SQL, matrix_sql(), wide_sql("wide", "matrix"),
       select='SELECT subject_id, name, ncr AS "NCR", ed AS "ED", et AS "ET", total_mm3 FROM wide'))
def v1(spark, folder):
    return regions.region_volumes_wide(matrix(spark, folder))


@query("o3_top_region_volumes", with_ctes(CELLS_SQL, LUT_SQL, matrix_sql(), wide_sql("wide", "matrix", ""),
       select='SELECT name, ncr AS "NCR", ed AS "ED", et AS "ET", total_mm3 FROM wide '
              "ORDER BY total_mm3 DESC, name LIMIT 12"))
def o3(spark, folder):
    return regions.top_region_volumes(matrix(spark, folder), 12, keys=())


@query("j14_paired_top_regions", with_ctes(
    CELLS_SQL, LUT_SQL, matrix_sql("mp", "pred"), matrix_sql("mr", "ref"),
    wide_sql("wp", "mp"), wide_sql("wr", "mr"), """
both_sides AS (
  SELECT subject_id, name, coalesce(wp.ncr, 0) AS "NCR_pred", coalesce(wp.ed, 0) AS "ED_pred",
         coalesce(wp.et, 0) AS "ET_pred", coalesce(wp.total_mm3, 0) AS total_pred,
         coalesce(wr.ncr, 0) AS "NCR_ref", coalesce(wr.ed, 0) AS "ED_ref",
         coalesce(wr.et, 0) AS "ET_ref", coalesce(wr.total_mm3, 0) AS total_ref
  FROM wp FULL JOIN wr USING (subject_id, name)),
ranked AS (
  SELECT *, greatest(total_pred, total_ref) AS rank_mm3,
    CAST(row_number() OVER (PARTITION BY subject_id
         ORDER BY greatest(total_pred, total_ref) DESC, name) AS INTEGER) AS rank
  FROM both_sides)""", select="SELECT * FROM ranked WHERE rank <= 8"))
def j14(spark, folder):
    return regions.paired_top_regions(
        matrix(spark, folder, "pred"), matrix(spark, folder, "ref"), 8)
