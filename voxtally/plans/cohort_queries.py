"""Cohort draw and description over the ``cohort`` and ``listing`` views."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtally.functions.text import normalize_subject_id, subject_id_from_exam, zero_fill
from voxtally.operators import cohort as ops
from voxtally.plans import bindings as b
from voxtally.plans.bindings import COHORT_SQL, with_ctes
from voxtally.plans.registry import query
from voxtally.session import run_folder
from voxtally.sources import tables

SEED = 20250101


def listed(spark, folder):
    return tables.listing_ids(b.listing(spark, folder))


def exams(spark, folder):
    return ops.baseline_exams(b.cohort(spark, folder))


def pool(spark, folder):
    return ops.eligible(exams(spark, folder), listed(spark, folder))


def binned(spark, folder):
    rows = pool(spark, folder)
    return ops.with_tertile(rows, ops.survival_cuts(rows))


@query("s2_metadata_scan", with_ctes(COHORT_SQL, select="""
SELECT subject_id, sex AS "Sex", diagnosis, os AS "OS", split FROM baseline"""))
def s2(spark, folder):
    path = run_folder(spark, "metadata")
    b.cohort(spark, folder).write.csv(path, header=True)
    rows = ops.baseline_exams(tables.read_metadata(spark, path))
    return rows.select(
        "subject_id", "Sex", F.col("Final pathologic diagnosis (WHO 2021)").alias("diagnosis"),
        "OS", F.col("BraTS21 Segmentation Cohort").alias("split"))


@query("s3_patient_scan", with_ctes(COHORT_SQL, select="""
SELECT exam AS "Patient", sex, os FROM cohort WHERE lower(trim(exam)) = 'ucsf-pdgm-048'"""))
def s3(spark, folder):
    path = run_folder(spark, "patients")
    b.cohort(spark, folder).select(
        F.col("ID").alias("Patient"), F.col("Sex").alias("sex"), F.col("OS").alias("os")
    ).write.csv(path, header=True)
    rows = tables.read_csv_text(spark, path, ["Patient", "sex", "os"])
    return tables.rows_of_patient(rows, " UCSF-PDGM-048 ")


@query("s8_availability_scan", with_ctes(COHORT_SQL, select="SELECT subject_id FROM available"))
def s8(spark, folder):
    return listed(spark, folder)


@query("p8_normalize_subject_id", """
SELECT s_suppkey, raw, CASE WHEN regexp_matches(bare, '^[0-9]{4}$') THEN bare END AS subject_id FROM (
  SELECT s_suppkey, raw, trim(regexp_replace(raw, '^sub-', '')) AS bare FROM (
    SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'sub-' || f WHEN 1 THEN ' ' || f || ' '
      WHEN 2 THEN f ELSE 'sub-x' || f END AS raw
    FROM (SELECT s_suppkey, CASE WHEN length(CAST(s_suppkey AS VARCHAR)) >= 4 THEN CAST(s_suppkey AS VARCHAR)
            ELSE lpad(CAST(s_suppkey AS VARCHAR), 4, '0') END AS f FROM supplier)))""")
def p8(spark, folder):
    k = F.col("s_suppkey")
    filled = zero_fill(k.cast("string"))
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit("sub-"), filled))
        .when(k % 4 == 1, F.concat(F.lit(" "), filled, F.lit(" ")))
        .when(k % 4 == 2, filled).otherwise(F.concat(F.lit("sub-x"), filled))
    )
    return b.table(spark, folder, "supplier").select("s_suppkey", raw.alias("raw")).withColumn(
        "subject_id", normalize_subject_id(F.col("raw"), strict=False))


@query("p9_exam_to_subject", with_ctes(COHORT_SQL, select="""
SELECT exam, subject_id FROM cohort LEFT JOIN (SELECT exam, subject_id FROM baseline) USING (exam)"""))
def p9(spark, folder):
    return b.cohort(spark, folder).select(
        F.col("ID").alias("exam"), subject_id_from_exam(F.col("ID")).alias("subject_id"))


@query("p10_survival_tertile", with_ctes(COHORT_SQL, select="""
SELECT subject_id, CAST(os AS BIGINT) AS os_days,
  CASE WHEN CAST(os AS BIGINT) <= 300 THEN 'short' WHEN CAST(os AS BIGINT) <= 900 THEN 'mid'
       ELSE 'long' END AS "OS_tertile"
FROM baseline WHERE regexp_matches(os, '^[0-9]+$')"""))
def p10(spark, folder):
    rows = exams(spark, folder).withColumn("os_days", F.col("OS").try_cast("bigint")).where(
        F.col("os_days").isNotNull())
    return ops.with_tertile(rows, (300, 900)).select("subject_id", "os_days", "OS_tertile")


@query("p11_eligible_pool", with_ctes(COHORT_SQL, select="SELECT subject_id, sex AS \"Sex\", os_days FROM pool"))
def p11(spark, folder):
    return pool(spark, folder).select("subject_id", "Sex", "os_days")


@query("j5_available_exams", with_ctes(COHORT_SQL, select="""
SELECT subject_id, exam FROM baseline SEMI JOIN available USING (subject_id)"""))
def j5(spark, folder):
    return ops.available(exams(spark, folder), listed(spark, folder)).select(
        "subject_id", F.col("ID").alias("exam"))


@query("w1_tertile_cuts", with_ctes(COHORT_SQL, select="SELECT t_low, t_high, n_pool FROM cuts"))
def w1(spark, folder):
    return ops.survival_cuts(pool(spark, folder))


DRAW_SQL = f"""
alloc(sex, tertile, k) AS (VALUES ('M','short',10), ('M','mid',10), ('M','long',10),
                                  ('F','short',7), ('F','mid',7), ('F','long',6)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sex, tertile
             ORDER BY md5('{SEED}' || subject_id), subject_id) AS draw FROM binned),
sample AS (SELECT * FROM ranked JOIN alloc USING (sex, tertile) WHERE draw <= k)"""


@query("w2_stratified_sample", with_ctes(COHORT_SQL, DRAW_SQL, select="""
SELECT subject_id, sex AS "Sex", tertile AS "OS_tertile", CAST(draw AS INTEGER) AS draw
FROM sample ORDER BY subject_id"""))
def w2(spark, folder):
    return ops.stratified_sample(binned(spark, folder), SEED).select(
        "subject_id", "Sex", "OS_tertile", "draw")


@query("j17_allocation", with_ctes(COHORT_SQL, DRAW_SQL, select="""
SELECT sex AS "Sex", tertile AS "OS_tertile", CAST(k AS BIGINT) AS k, coalesce(n, 0) AS n_available,
       least(k, coalesce(n, 0)) AS n_taken, coalesce(n, 0) < k AS short
FROM alloc LEFT JOIN (SELECT sex, tertile, count(*) AS n FROM binned GROUP BY 1, 2) USING (sex, tertile)"""))
def j17(spark, folder):
    return ops.allocation_cells(binned(spark, folder))


@query("j1_cohort_metadata", with_ctes(COHORT_SQL, select="""
SELECT subject_id, exam, sex, os FROM baseline SEMI JOIN pool USING (subject_id)"""))
def j1(spark, folder):
    return ops.join_cohort(pool(spark, folder), exams(spark, folder)).select(
        "subject_id", F.col("ID").alias("exam"), F.col("Sex").alias("sex"), F.col("OS").alias("os"))


@query("u2_missing_ids", with_ctes(COHORT_SQL, select="""
SELECT subject_id FROM available EXCEPT SELECT subject_id FROM baseline"""))
def u2(spark, folder):
    return ops.missing_ids(listed(spark, folder), exams(spark, folder))


FIELDS_SQL = """
SELECT field, value, count(*) AS n FROM (
  SELECT 'Sex' AS field, sex AS value FROM {rows}
  {tertile}
  UNION ALL SELECT 'MGMT status', mgmt FROM {rows} UNION ALL SELECT 'EOR', eor FROM {rows}
  UNION ALL SELECT '1-dead 0-alive', dead FROM {rows}
  UNION ALL SELECT 'BraTS21 Segmentation Cohort', coalesce(split, 'unused') FROM {rows})
GROUP BY 1, 2"""


@query("a23_cohort_counts", with_ctes(COHORT_SQL, select=FIELDS_SQL.format(
    rows="binned", tertile="UNION ALL SELECT 'OS_tertile', tertile FROM binned")))
def a23(spark, folder):
    return ops.attribute_counts(binned(spark, folder), ops.COUNTED_FIELDS)


@query("a23_cohort_numbers", with_ctes(COHORT_SQL, """
nums AS (SELECT 'age_years' AS field, CAST(age AS DOUBLE) AS v FROM pool
         UNION ALL SELECT 'os_days', CAST(os AS DOUBLE) FROM pool)""", select="""
SELECT field, count(*) AS n, median(v) AS median, avg(v) AS mean, min(v) AS min, max(v) AS max
FROM nums GROUP BY 1"""), rounded=["median", "mean", "min", "max"])
def a23_numbers(spark, folder):
    return ops.numeric_summary(pool(spark, folder))


@query("a24_draw_counters", with_ctes(COHORT_SQL, DRAW_SQL, select=FIELDS_SQL.format(
    rows="sample", tertile="")))
def a24(spark, folder):
    return ops.attribute_counts(ops.stratified_sample(binned(spark, folder), SEED))
