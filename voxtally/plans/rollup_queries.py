"""Lobe and functional-group roll-ups over the region matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtally.constants import FUNCTIONAL_GROUPS, LOBES
from voxtally.functions.text import lobe
from voxtally.operators import rollups
from voxtally.plans import bindings as b
from voxtally.plans.bindings import CELLS_SQL, COMPARTMENTS_SQL, LUT_SQL, matrix_sql, with_ctes
from voxtally.plans.region_queries import HEMI_SQL, STEM_SQL, lobe_sql, matrix, named_regions
from voxtally.plans.registry import query

MM3 = 1.5
SCALED_SQL = f"""
hp0 AS (SELECT subject_id, label, name, compartment, parcel_voxels, overlap_voxels,
               overlap_voxels * {MM3}::DOUBLE AS mm3, {STEM_SQL} AS stem, {HEMI_SQL} AS hemisphere
        FROM matrix),
hp AS (SELECT *, {lobe_sql('stem')} AS lobe FROM hp0),
vv AS (SELECT subject_id, coalesce(median(mm3 / overlap_voxels) FILTER (WHERE overlap_voxels > 0), 1.0::DOUBLE)
              AS voxel_volume_mm3 FROM hp GROUP BY 1),
lab AS (SELECT DISTINCT subject_id, label, parcel_voxels, lobe, stem, hemisphere FROM hp),
subs AS (SELECT DISTINCT subject_id FROM hp),
ctot AS (SELECT subject_id, compartment, sum(mm3) AS total FROM hp GROUP BY 1, 2)"""
LOBES_SQL = "lobes(lobe) AS (VALUES {})".format(", ".join(f"('{x}')" for x in LOBES))
LOBE_CELLS_SQL = """
lv AS (SELECT subject_id, lobe, sum(parcel_voxels) AS voxels FROM lab GROUP BY 1, 2),
lo AS (SELECT subject_id, lobe, compartment, sum(mm3) AS mm3 FROM hp GROUP BY 1, 2, 3),
lobe_cells AS (
  SELECT subject_id, lobe, compartment,
    coalesce(voxels * voxel_volume_mm3, 0) AS lobe_volume_mm3, coalesce(mm3, 0) AS overlap_volume_mm3,
    CASE WHEN voxels > 0 THEN 100 * coalesce(mm3, 0) / (voxels * voxel_volume_mm3) END AS share_of_lobe_pct,
    CASE WHEN total > 0 THEN 100 * coalesce(mm3, 0) / total END AS share_of_compartment_pct
  FROM (SELECT * FROM subs, lobes, comps) LEFT JOIN lv USING (subject_id, lobe)
    LEFT JOIN lo USING (subject_id, lobe, compartment) LEFT JOIN ctot USING (subject_id, compartment)
    LEFT JOIN vv USING (subject_id))"""
CTES = (CELLS_SQL, LUT_SQL, COMPARTMENTS_SQL, matrix_sql(), SCALED_SQL, LOBES_SQL)

GROUPS_SQL = "grps(group_id, group_label, group_type) AS (VALUES {})".format(", ".join(
    f"('{g}', '{label}', '{kind}')" for g, (label, kind) in rollups.GROUP_LABELS.items()))
MEMBERS_SQL = "fmem(group_id, side, stem) AS (VALUES {})".format(", ".join(
    f"('{g}', {repr(side) if side else 'NULL'}, '{s}')"
    for g, _, side, stems in FUNCTIONAL_GROUPS for s in stems))
GROUP_CELLS_SQL = """
lg AS (SELECT subject_id, label, parcel_voxels, 'lobe:' || lobe AS group_id FROM lab
       UNION ALL SELECT subject_id, label, parcel_voxels, group_id FROM lab JOIN fmem f
         ON lab.stem = f.stem AND (f.side IS NULL OR f.side = lab.hemisphere)),
gv AS (SELECT subject_id, group_id, sum(parcel_voxels) AS voxels FROM lg GROUP BY 1, 2),
go AS (SELECT subject_id, group_id, compartment, sum(mm3) AS mm3
       FROM lg JOIN hp USING (subject_id, label) GROUP BY 1, 2, 3),
group_cells AS (
  SELECT subject_id, group_id, group_label, group_type, compartment,
    coalesce(voxels * voxel_volume_mm3, 0) AS group_volume_mm3, coalesce(mm3, 0) AS overlap_volume_mm3,
    CASE WHEN voxels > 0 THEN 100 * coalesce(mm3, 0) / (voxels * voxel_volume_mm3) END AS share_of_group_pct,
    CASE WHEN total > 0 THEN 100 * coalesce(mm3, 0) / total END AS share_of_compartment_pct
  FROM (SELECT * FROM subs, grps, comps) LEFT JOIN gv USING (subject_id, group_id)
    LEFT JOIN go USING (subject_id, group_id, compartment)
    LEFT JOIN ctot USING (subject_id, compartment) LEFT JOIN vv USING (subject_id))"""
GROUP_CTES = (*CTES, GROUPS_SQL, MEMBERS_SQL, GROUP_CELLS_SQL)
LOBE_DOUBLES = ["lobe_volume_mm3", "overlap_volume_mm3", "share_of_lobe_pct", "share_of_compartment_pct"]
GROUP_DOUBLES = ["group_volume_mm3", *LOBE_DOUBLES[1:2], "share_of_group_pct", "share_of_compartment_pct"]

COHORT_SQL = f"""
members AS (SELECT {b.sql_zero_fill("CAST(s_suppkey AS VARCHAR)")} AS subject_id,
  CASE s_suppkey % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'mid' ELSE 'long' END AS tertile FROM supplier)"""


def cohort(spark, folder):
    """Every supplier is a member; only some members have a region table."""
    k = F.col("s_suppkey")
    return b.table(spark, folder, "supplier").select(
        b._subject(k).alias("subject_id"),
        F.when(k % 3 == 0, "short").when(k % 3 == 1, "mid").otherwise("long").alias("OS_tertile"))


def scaled(spark, folder):
    return matrix(spark, folder, voxel_mm3=MM3)


@query("p14_functional_groups", with_ctes(CELLS_SQL, LUT_SQL, MEMBERS_SQL, f"""
seen AS (SELECT DISTINCT region AS label FROM cells),
named AS (SELECT label, name, {STEM_SQL} AS stem, {HEMI_SQL} AS hemisphere FROM seen JOIN lut USING (label))""",
       select=f"""
SELECT label, name, 'lobe:' || {lobe_sql('stem')} AS group_id FROM named
UNION ALL SELECT label, name, group_id FROM named JOIN fmem f
  ON named.stem = f.stem AND (f.side IS NULL OR f.side = named.hemisphere)"""))
def p14(spark, folder):
    return rollups.region_groups(named_regions(spark, folder).where(F.col("name").isNotNull()))


@query("a18_lobe_cells", with_ctes(*CTES, LOBE_CELLS_SQL, select="SELECT * FROM lobe_cells"),
       rounded=LOBE_DOUBLES)
def a18(spark, folder):
    return rollups.lobe_cells(scaled(spark, folder))


@query("a19_group_cells", with_ctes(*GROUP_CTES, select="SELECT * FROM group_cells"),
       rounded=GROUP_DOUBLES)
def a19(spark, folder):
    return rollups.group_cells(scaled(spark, folder))


@query("a20_voxel_volume", with_ctes(*CTES, select="SELECT * FROM vv"), rounded=["voxel_volume_mm3"])
def a20(spark, folder):
    return rollups.inferred_voxel_volume(scaled(spark, folder))


@query("j6_dense_grid", with_ctes(*CTES, LOBE_CELLS_SQL, select="""
SELECT lobe, compartment, count(*) AS n_subjects, count(*) FILTER (WHERE overlap_volume_mm3 = 0) AS n_empty
FROM lobe_cells GROUP BY 1, 2"""))
def j6(spark, folder):
    return rollups.lobe_cells(scaled(spark, folder)).groupBy("lobe", "compartment").agg(
        F.count(F.lit(1)).alias("n_subjects"),
        F.count_if(F.col("overlap_volume_mm3") == 0).alias("n_empty"))


@query("w10_lobe_voxels", with_ctes(*CTES, select="""
SELECT subject_id, lobe, CAST(sum(parcel_voxels) AS BIGINT) AS lobe_voxels FROM lab GROUP BY 1, 2"""))
def w10(spark, folder):
    once = scaled(spark, folder).dropDuplicates(["subject_id", "label"])
    return once.groupBy("subject_id", lobe(F.col("name")).alias("lobe")).agg(
        F.sum("parcel_voxels").alias("lobe_voxels"))


@query("w11_share_of_compartment", with_ctes(*CTES, LOBE_CELLS_SQL, select="""
SELECT subject_id, lobe, compartment, share_of_compartment_pct FROM lobe_cells"""),
       rounded=["share_of_compartment_pct"])
def w11(spark, folder):
    return rollups.lobe_cells(scaled(spark, folder)).select(
        "subject_id", "lobe", "compartment", "share_of_compartment_pct")


def summary_sql(rows: str, key: str, share: str, domain: str, contexts: str) -> str:
    def quartiles(column: str, name: str, suffix: str = "", extra: str = "") -> str:
        return ", ".join(
            f"quantile_cont({column}, {p}) FILTER (WHERE {column} IS NOT NULL{extra}) AS {name}_{q}{suffix}"
            for q, p in (("median", 0.5), ("p25", 0.25), ("p75", 0.75)))

    return f"""
ctx AS (SELECT subject_id, context FROM members, (VALUES ('all'), ('short'), ('mid'), ('long')) AS x(context)
        WHERE context IN ({contexts}) AND (context = 'all' OR context = tertile)),
nt AS (SELECT context, count(*) AS n_total FROM ctx GROUP BY 1),
nw AS (SELECT context, count(DISTINCT subject_id) AS n_with_table FROM {rows} JOIN ctx USING (subject_id) GROUP BY 1),
agg AS (SELECT context, {key}, compartment,
    count(*) FILTER (WHERE overlap_volume_mm3 > 0) AS n_with_overlap,
    sum(overlap_volume_mm3) AS total_overlap_volume_mm3_sum,
    {quartiles('share_of_compartment_pct', 'share_of_compartment_pct')},
    {quartiles(share, share, '_when_present', ' AND overlap_volume_mm3 > 0')}
  FROM {rows} JOIN ctx USING (subject_id) GROUP BY 1, 2, 3),
summary AS (
  SELECT * EXCLUDE (n_with_overlap, total_overlap_volume_mm3_sum, n_total, n_with_table),
    coalesce(n_total, 0) AS n_total, coalesce(n_with_table, 0) AS n_with_table,
    coalesce(n_with_overlap, 0) AS n_with_overlap,
    coalesce(total_overlap_volume_mm3_sum, 0) AS total_overlap_volume_mm3_sum,
    coalesce(n_with_overlap, 0)::DOUBLE / greatest(coalesce(n_total, 0), 1) AS prevalence
  FROM (SELECT context, {key}, compartment FROM (SELECT DISTINCT context FROM ctx), {domain}, comps)
    LEFT JOIN nt USING (context) LEFT JOIN nw USING (context)
    LEFT JOIN agg USING (context, {key}, compartment))"""


def summary_doubles(share: str) -> list[str]:
    return [
        "prevalence", "total_overlap_volume_mm3_sum",
        *[f"share_of_compartment_pct_{q}" for q in ("median", "p25", "p75")],
        *[f"{share}_{q}_when_present" for q in ("median", "p25", "p75")],
    ]


@query("a21_cohort_cell_summary", with_ctes(*CTES, LOBE_CELLS_SQL, COHORT_SQL,
       summary_sql("lobe_cells", "lobe", "share_of_lobe_pct", "lobes", "'all'"),
       select="SELECT * FROM summary"), rounded=summary_doubles("share_of_lobe_pct"))
def a21(spark, folder):
    return rollups.cohort_cells(rollups.lobe_cells(scaled(spark, folder)), cohort(spark, folder))


@query("a22_context_summary", with_ctes(*GROUP_CTES, COHORT_SQL,
       summary_sql("group_cells", "group_id", "share_of_group_pct", "grps",
                   "'all', 'short', 'mid', 'long'"),
       select="SELECT * FROM summary"), rounded=summary_doubles("share_of_group_pct"))
def a22(spark, folder):
    members = cohort(spark, folder)
    cells = rollups.group_cells(scaled(spark, folder), members)
    return rollups.context_cells(cells, members)
