"""Scans and sinks: what the given tables yield is written out, read back and checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtally.operators import rollups
from voxtally.plans import bindings as b
from voxtally.plans.bindings import (
    CELLS_SQL,
    COMPARTMENTS_SQL,
    LUT_SQL,
    VOLUMES_SQL,
    matrix_sql,
    with_ctes,
)
from voxtally.plans.documents import DOCUMENT_CTES, PAIRS, documents
from voxtally.plans.inventory_queries import RUNS_SQL, run_documents
from voxtally.plans.region_queries import MATRIX_DOUBLES, matrix
from voxtally.plans.registry import query
from voxtally.session import cut_lineage, run_folder
from voxtally.sources import sinks, tables
from voxtally.streaming import ingest

BUCKETS = 16
MATRIX_CTES = (CELLS_SQL, LUT_SQL, matrix_sql())


@query("s1_voxel_scan", with_ctes(VOLUMES_SQL, select="""
SELECT subject_id, x, y, z, ref AS label FROM volumes WHERE ref > 0"""))
def s1(spark, folder):
    path = run_folder(spark, "voxels")
    voxels = b.volumes(spark, folder)
    long = voxels.select("subject_id", "x", "y", "z", F.inline(F.array(
        F.struct(F.lit("dl").alias("source"), F.col("pred").alias("label")),
        F.struct(F.lit("gt").alias("source"), F.col("ref").alias("label")),
    ))).where("label > 0")
    long.write.partitionBy("source").parquet(path)
    return tables.read_voxels(spark, path, "gt").drop("source")


def defective_tables(spark, folder):
    """Region tables as text, some with a foreign compartment or a malformed number."""
    n = F.col("subject_id").cast("int") % 5
    rows = matrix(spark, folder)
    return rows.select("subject_id", *[F.col(c).cast("string").alias(c) for c in tables.REGION_TABLE_TYPES]) \
        .withColumns({
            "compartment": F.when((n == 1) & (F.col("compartment") == "WT"), "XX").otherwise(F.col("compartment")),
            "parcel_voxels": F.when((n == 2) & (F.col("compartment") == "ET"), "many").otherwise(F.col("parcel_voxels")),
        })


def stored_tables(spark, folder):
    path = run_folder(spark, "region-tables")
    sinks.bucketed(defective_tables(spark, folder), ["subject_id"], BUCKETS).select(
        *tables.REGION_TABLE_TYPES, "subject_id", "bucket").write.partitionBy("bucket").csv(path, header=True)
    return tables.check_region_tables(tables.read_region_tables(spark, path))


@query("s5_region_table_scan", with_ctes(*MATRIX_CTES, select="""
SELECT * FROM matrix WHERE CAST(subject_id AS INTEGER) % 5 NOT IN (1, 2)"""), rounded=MATRIX_DOUBLES)
def s5(spark, folder):
    return stored_tables(spark, folder)[0]


@query("s5_region_table_problems", with_ctes(*MATRIX_CTES, select="""
SELECT DISTINCT subject_id, CASE WHEN CAST(subject_id AS INTEGER) % 5 = 1 THEN 'unexpected compartment: XX'
  ELSE 'malformed row' END AS reason
FROM matrix WHERE CAST(subject_id AS INTEGER) % 5 IN (1, 2)"""))
def s5_problems(spark, folder):
    return stored_tables(spark, folder)[1]


def lut_documents(spark, folder):
    """One JSON lookup per subject over the labels it has; some are broken."""
    n = F.col("subject_id").cast("int") % 7
    present = matrix(spark, folder).select("subject_id", "label", "name").distinct()
    # A lookup has as many entries as the label scheme.
    docs = present.groupBy("subject_id").agg(F.to_json(F.map_from_entries(F.collect_list(
        F.struct(F.col("label").cast("string"), F.col("name"))))).alias("text"))
    return docs.select("subject_id", (
        F.when(n == 1, F.lit("{}")).when(n == 2, F.lit('{"17": "Left-Hippo'))
        .when(n == 3, F.concat(F.lit('{"abc":"x",'), F.expr("substring(text, 2)")))
        .when(n == 4, F.lit("[1, 2]")).otherwise(F.col("text"))).alias("value"))


@query("s6_lut_scan", with_ctes(*MATRIX_CTES, select="""
SELECT DISTINCT subject_id, label, name FROM matrix
WHERE CAST(subject_id AS INTEGER) % 7 NOT IN (1, 2, 3, 4)"""))
def s6(spark, folder):
    path = run_folder(spark, "luts")
    sinks.bucketed(lut_documents(spark, folder), ["subject_id"], BUCKETS).write.partitionBy("bucket").json(path)
    return tables.parse_lut_documents(spark.read.schema("value STRING, subject_id STRING").json(path))[0]


@query("s6_lut_problems", with_ctes(*MATRIX_CTES, select="""
SELECT DISTINCT subject_id, CASE CAST(subject_id AS INTEGER) % 7 WHEN 1 THEN 'empty lookup' WHEN 2 THEN 'invalid JSON'
  WHEN 3 THEN 'bad label key: abc' ELSE 'root is not an object' END AS reason
FROM matrix WHERE CAST(subject_id AS INTEGER) % 7 IN (1, 2, 3, 4)"""))
def s6_problems(spark, folder):
    return tables.parse_lut_documents(lut_documents(spark, folder))[1]


@query("s7_color_table_scan", """
SELECT CAST(p_partkey AS INTEGER) AS label, replace(p_name, ' ', '_') AS name, p_size AS r,
       CAST(p_partkey % 256 AS INTEGER) AS g, CAST(p_partkey % 7 AS INTEGER) AS b
FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0""")
def s7(spark, folder):
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    line = F.concat_ws(
        "  ", F.when(k % 17 == 0, "x1").otherwise(text(k)), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")),
        text(F.col("p_size")), text(k % 256), F.when(k % 13 != 0, text(k % 7)),
        F.when(k % 13 != 0, F.lit("0")))
    lines = b.table(spark, folder, "part").select(
        F.when(k % 7 == 0, F.concat(F.lit("  # "), line)).when(k % 11 == 0, "   ").otherwise(
            F.concat(F.lit(" "), line)).alias("value"))
    path = run_folder(spark, "color-table")
    lines.write.text(path)
    return tables.require_rows(
        tables.parse_color_table(spark.read.text(path)), "color table")


@query("k1_csv_sink", with_ctes(*MATRIX_CTES, select="""
SELECT subject_id, label, name, compartment, overlap_voxels FROM matrix"""))
def k1(spark, folder):
    path = run_folder(spark, "csv")
    rows = matrix(spark, folder).select("subject_id", "label", "name", "compartment", "overlap_voxels")
    sinks.write_csv(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True)


@query("k2_json_summary_sink", with_ctes(*MATRIX_CTES, DOCUMENT_CTES[1], DOCUMENT_CTES[2], """
cells_ AS (SELECT name, compartment, sum(overlap_voxels) AS n FROM matrix GROUP BY 1, 2)""", select="""
SELECT '1.0' AS schema_version, (SELECT count(*) FROM cells_) AS n_cells,
       (SELECT count(*) FROM docs WHERE reason IS NOT NULL) AS n_problems,
       (SELECT CAST(sum(n) AS BIGINT) FROM cells_) AS total_overlap"""))
def k2(spark, folder):
    from voxtally.plans.robust_queries import parsed
    from voxtally.sources.sidecars import sidecar_problems

    path = run_folder(spark, "summary")
    report = matrix(spark, folder).groupBy("name", "compartment").agg(
        F.sum("overlap_voxels").alias("overlap_voxels"))
    sinks.write_json_summary(sinks.summary_document(report, sidecar_problems(parsed(spark, folder))), path)
    schema = ("schema_version STRING, n_cells BIGINT, n_problems BIGINT, "
              "cells ARRAY<STRUCT<overlap_voxels: BIGINT>>")
    return spark.read.schema(schema).json(path).select(
        "schema_version", "n_cells", "n_problems",
        F.aggregate("cells", F.lit(0).cast("bigint"), lambda a, c: a + c.overlap_voxels).alias("total_overlap"))


@query("k3_idempotent_write", with_ctes(*MATRIX_CTES, select="""
SELECT subject_id, label, compartment, overlap_voxels,
       CASE WHEN CAST(subject_id AS INTEGER) % 2 = 0 THEN 'first' ELSE 'second' END AS run FROM matrix"""))
def k3(spark, folder):
    path = run_folder(spark, "resumed")
    rows = matrix(spark, folder).select("subject_id", "label", "compartment", "overlap_voxels")
    even = F.col("subject_id").cast("int") % 2 == 0
    sinks.write_missing(rows.where(even).withColumn("run_name", F.lit("first")), path, ["subject_id"])
    sinks.write_missing(rows.withColumn("run_name", F.lit("second")), path, ["subject_id"])
    return sinks.read_written(spark, path, ["subject_id"]).withColumnRenamed("run_name", "run")


@query("t1_incremental_ingest", with_ctes(*DOCUMENT_CTES, select="""
SELECT subject_id, pair_id, compartment, metric, value, status FROM ml"""), rounded=["value"])
def t1(spark, folder):
    return ingest.read_ingested(spark, ingested(spark, folder), "metrics").drop("raw")


def ingested(spark, folder):
    """Metric and run documents that arrive in two steps, each taken in before the next."""
    base = run_folder(spark, "ingest")
    source, target, state = (f"{base}/{x}" for x in ("in", "out", "state"))
    empty = F.lit(None).cast("string")
    metrics = documents(spark, folder).select(
        F.lit(ingest.METRICS).alias("kind"), "subject_id", "pair_id", empty.alias("stage"), empty.alias("run_id"), "value",
        (F.col("pair_id") == PAIRS[2]).alias("early"))
    runs = run_documents(spark, folder).select(
        F.lit(ingest.RUNS).alias("kind"), "subject_id", empty.alias("pair_id"), "stage",
        F.col("run_id").cast("string").alias("run_id"), "value", (F.col("run_id") % 3 == 0).alias("early"))
    docs = cut_lineage(metrics.unionByName(runs))
    for step in (F.col("early"), ~F.col("early")):
        docs.where(step).drop("early").write.mode("append").json(source)
        ingest.ingest_sidecars(spark, source, target, state)
    return target


@query("t1_two_kinds", with_ctes(*DOCUMENT_CTES, RUNS_SQL.strip(), select="""
SELECT 'metrics' AS table_name, count(*) AS n, count(DISTINCT (subject_id, pair_id, compartment, metric)) AS n_keys,
       round(sum(CASE WHEN status = 'ok' THEN value END), 3) + 0.0::DOUBLE AS total FROM ml
UNION ALL SELECT 'metric_problems', count(*), count(DISTINCT (subject_id, pair_id)), NULL FROM docs WHERE reason IS NOT NULL
UNION ALL SELECT 'runs', count(*), count(DISTINCT run_id), round(sum(elapsed_s), 3) + 0.0::DOUBLE FROM good
UNION ALL SELECT 'run_problems', count(*), count(DISTINCT run_id), NULL FROM runs WHERE reason IS NOT NULL"""))
def t1_two_kinds(spark, folder):
    """All four tables of one ingest: nothing lost, nothing twice."""
    target = ingested(spark, folder)

    def counted(name, keys, total):
        rows = ingest.read_ingested(spark, target, name)
        each = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("t"))
        return each.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("n_keys"),
            (F.round(F.sum("t"), 3) + F.lit(0.0)).alias("total")).select(F.lit(name).alias("table_name"), "*")

    none = F.lit(None).cast("double")
    return counted("metrics", ["subject_id", "pair_id", "compartment", "metric"], F.when(F.col("status") == "ok", F.col("value"))) \
        .unionByName(counted("metric_problems", ["subject_id", "pair_id"], none)) \
        .unionByName(counted("runs", ["run_id"], F.col("elapsed_s"))) \
        .unionByName(counted("run_problems", ["run_id"], none))


@query("t1_ingested_runs", f"""WITH {RUNS_SQL}
SELECT CAST(run_id AS VARCHAR) AS run_id, subject_id, stage, elapsed_s, device, version FROM good""")
def t1_runs(spark, folder):
    return ingest.read_ingested(spark, ingested(spark, folder), "runs").select(
        "run_id", "subject_id", "stage", "elapsed_s", "device", "version")


@query("a18_from_stored_tables", with_ctes(CELLS_SQL, LUT_SQL, COMPARTMENTS_SQL, matrix_sql(), select="""
SELECT subject_id, compartment, CAST(sum(overlap_voxels) AS DOUBLE) AS overlap_volume_mm3
FROM matrix WHERE CAST(subject_id AS INTEGER) % 5 NOT IN (1, 2) GROUP BY 1, 2"""),
       rounded=["overlap_volume_mm3"])
def a18_stored(spark, folder):
    """Stored tables through the lobe roll-up: the lobes of a subject add up to its regions."""
    cells = rollups.lobe_cells(stored_tables(spark, folder)[0])
    return cells.groupBy("subject_id", "compartment").agg(
        F.sum("overlap_volume_mm3").alias("overlap_volume_mm3"))
