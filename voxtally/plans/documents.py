"""Sidecar documents derived from the ``cells`` view, defects included, and their SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.constants import COMPARTMENTS
from voxtally.functions.numbers import json_number
from voxtally.operators import agreement
from voxtally.plans import bindings as b
from voxtally.plans.bindings import CELLS_SQL, COMPARTMENTS_SQL, sql_masked

PAIRS = ("dl_vs_raidionics", "dl_vs_segmentglioma", "dl_vs_gt")
DEFECTS = 40


def pair_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics per (subject, pair, compartment); the raw code picks the pair of a voxel."""
    pairs = F.array(*[F.lit(p) for p in PAIRS])
    cells = b.cells(spark, folder).withColumn(
        "pair_id", F.get(pairs, (F.col("raw") % 3).cast("int")))
    counts = agreement.confusion_counts(cells, keys=("subject_id", "pair_id"))
    one_empty = (F.col("n_pred") == 0) | (F.col("n_ref") == 0)
    both_empty = (F.col("n_pred") == 0) & (F.col("n_ref") == 0)
    # Some subjects have no surface on one side, so that infinite distances occur at any size.
    lost = (F.col("subject_id").cast("int") % 7 == 3) & (F.col("compartment") == "ET")
    apart = F.col("n_pred") - F.col("n_both")
    return agreement.overlap_metrics(counts, 1.5).withColumn(
        "hd95_mm",
        F.when(both_empty, None).when(one_empty | lost, float("inf"))
        .otherwise(F.sqrt((apart * apart).cast("double"))),
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(subject_id, pair_id, value): one JSON text each, a share of them broken."""
    leaf = lambda m: F.concat(F.lit(f'"{m}":'), json_number(F.col(m)))
    kind = (F.col("subject_id").cast("int") * 3 + F.array_position(
        F.array(*[F.lit(p) for p in PAIRS]), F.col("pair_id"))) % DEFECTS
    odd = (
        F.when(kind == 7, F.lit('"oops"')).when(kind == 8, F.lit("true"))
        .when(kind == 9, F.lit('"NaN"')).when(kind == 10, F.lit('"-INF"'))
        .when(kind == 11, F.lit('"0.5"'))
    )
    dice = F.when((F.col("compartment") == "WT") & odd.isNotNull(), odd).otherwise(
        json_number(F.col("dice")))
    body = F.concat_ws(
        ",",
        F.concat(F.lit('"dice":'), dice),
        leaf("hd95_mm"), leaf("abs_volumetric_error_mm3"), leaf("sensitivity"),
        F.when((kind == 6) & (F.col("compartment") == "ET"), None).otherwise(leaf("specificity")),
    )
    cell = F.concat(F.lit('"'), F.col("compartment"), F.lit('":{'), body, F.lit("}"))
    each = pair_metrics(spark, folder).select(
        "subject_id", "pair_id", "compartment", kind.alias("kind"), cell.alias("cell"))
    parts = each.groupBy("subject_id", "pair_id", "kind").agg(*[
        F.max(F.when(F.col("compartment") == c, F.col("cell"))).alias(c) for c in COMPARTMENTS
    ])
    kind = F.col("kind")
    metrics = F.when(kind == 4, F.lit("[1]")).otherwise(F.concat(
        F.lit("{"),
        F.concat_ws(",", "WT", F.when(kind != 5, F.col("TC")), "ET"),
        F.lit("}")))
    version = F.when(kind == 1, F.lit("")).when(kind == 2, F.lit('"schema_version":"2.0",')) \
        .otherwise(F.lit('"schema_version":"1.0",'))
    comparison = F.when(kind == 3, F.lit("something_else")).otherwise(F.col("pair_id"))
    text = F.concat(
        F.lit("{"), version, F.lit('"subject_id":"sub-'), F.col("subject_id"),
        F.lit('","comparison":"'), comparison, F.lit('","metrics":'), metrics,
        F.when(kind == 0, F.lit("")).otherwise(F.lit("}")))
    return parts.select("subject_id", "pair_id", text.alias("value"))


DOCUMENTS_SQL = f"""
pm0 AS (
  SELECT subject_id, CASE raw % 3 WHEN 0 THEN '{PAIRS[0]}' WHEN 1 THEN '{PAIRS[1]}' ELSE '{PAIRS[2]}' END AS pair_id,
         (CAST(subject_id AS INTEGER) * 3 + raw % 3 + 1) % {DEFECTS} AS kind, compartment,
         count(*) FILTER (WHERE {sql_masked('pred')}) AS p,
         count(*) FILTER (WHERE {sql_masked('ref')}) AS g,
         count(*) FILTER (WHERE ({sql_masked('pred')}) AND ({sql_masked('ref')})) AS i,
         count(*) AS n
  FROM cells, comps GROUP BY ALL),
pm AS (
  SELECT subject_id, pair_id, kind, compartment, metric,
    CASE metric
      WHEN 'dice' THEN CASE WHEN p + g > 0 THEN 2.0::DOUBLE * i / (p + g) END
      WHEN 'hd95_mm' THEN CASE WHEN p = 0 AND g = 0 THEN NULL
           WHEN p = 0 OR g = 0 OR (CAST(subject_id AS INTEGER) % 7 = 3 AND compartment = 'ET')
           THEN 'inf'::DOUBLE ELSE CAST(p - i AS DOUBLE) END
      WHEN 'abs_volumetric_error_mm3' THEN abs((p - g) * 1.5::DOUBLE)
      WHEN 'sensitivity' THEN CASE WHEN g > 0 THEN 1.0::DOUBLE * i / g END
      ELSE CASE WHEN n > g THEN 1.0::DOUBLE * (n - p - g + i) / (n - g) END END AS number
  FROM pm0, (VALUES ('dice'), ('hd95_mm'), ('abs_volumetric_error_mm3'), ('sensitivity'),
                    ('specificity')) AS m(metric)),
docs AS (
  SELECT DISTINCT subject_id, pair_id, CASE kind
    WHEN 0 THEN 'could not parse JSON' WHEN 1 THEN 'missing ''schema_version'''
    WHEN 2 THEN 'schema_version not accepted: 2.0' WHEN 3 THEN 'unexpected comparison: something_else'
    WHEN 4 THEN '''metrics'' must be a mapping' WHEN 5 THEN 'missing compartment TC'
    WHEN 6 THEN 'missing metric ET.specificity' END AS reason FROM pm),
ml AS (
  SELECT subject_id, pair_id, compartment, metric, kind,
    CASE WHEN odd THEN CASE kind WHEN 10 THEN 'inf' ELSE 'missing' END
         WHEN number IS NULL THEN 'missing' WHEN isinf(number) THEN 'inf' ELSE 'ok' END AS status,
    CASE WHEN odd THEN CASE kind WHEN 10 THEN 'inf'::DOUBLE END ELSE number END AS value,
    CASE WHEN odd THEN CASE kind WHEN 8 THEN 1.0::DOUBLE WHEN 10 THEN '-inf'::DOUBLE
                                 WHEN 11 THEN 0.5::DOUBLE END ELSE number END AS loose
  FROM (SELECT *, kind BETWEEN 7 AND 11 AND compartment = 'WT' AND metric = 'dice' AS odd FROM pm)
  WHERE kind > 6)
"""
DOCUMENT_CTES = (CELLS_SQL, COMPARTMENTS_SQL, DOCUMENTS_SQL)
