"""Sidecars, robust summaries and quality checks over the derived documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtally.functions import numbers
from voxtally.operators import quality, robust
from voxtally.plans import bindings as b
from voxtally.plans.bindings import with_ctes
from voxtally.plans.documents import DOCUMENT_CTES, PAIRS, documents, pair_metrics
from voxtally.plans.registry import query
from voxtally.session import run_folder
from voxtally.sources import sidecars

METRICS_SQL = """
mets(metric, digits) AS (VALUES ('dice', 3), ('hd95_mm', 2), ('abs_volumetric_error_mm3', 0),
                                ('sensitivity', 3), ('specificity', 3))"""
PAIRS_SQL = "prs(pair_id) AS (VALUES {})".format(", ".join(f"('{p}')" for p in PAIRS))


def parsed(spark, folder):
    return sidecars.parse_metric_sidecars(documents(spark, folder))


def long(spark, folder):
    return sidecars.metrics_long(parsed(spark, folder))


@query("s4_sidecar_scan", with_ctes(*DOCUMENT_CTES, select="SELECT subject_id, pair_id, reason FROM docs"))
def s4(spark, folder):
    path = run_folder(spark, "sidecars")
    documents(spark, folder).write.json(path)
    read = sidecars.parse_metric_sidecars(sidecars.read_document_lines(spark, path))
    return read.select("subject_id", "pair_id", "reason")


@query("s4_sidecar_problems", with_ctes(*DOCUMENT_CTES, select="""
SELECT subject_id, pair_id, reason FROM docs WHERE reason IS NOT NULL"""))
def s4_problems(spark, folder):
    return sidecars.sidecar_problems(parsed(spark, folder))


@query("k4_long_audit", with_ctes(*DOCUMENT_CTES, select="""
SELECT subject_id, pair_id, compartment, metric, value, status FROM ml"""), rounded=["value"])
def k4(spark, folder):
    return long(spark, folder).drop("raw")


@query("p15_metric_status", with_ctes(*DOCUMENT_CTES, select="""
SELECT pair_id, compartment, metric, status, count(*) AS n FROM ml GROUP BY ALL"""))
def p15(spark, folder):
    return long(spark, folder).groupBy("pair_id", "compartment", "metric", "status").agg(
        F.count(F.lit(1)).alias("n"))


QUALITY_SQL = """
qm AS (
  SELECT subject_id, compartment, max(loose) FILTER (WHERE metric = 'dice') AS dice,
         max(loose) FILTER (WHERE metric = 'hd95_mm') AS hd95_mm
  FROM ml WHERE pair_id = 'dl_vs_gt' GROUP BY 1, 2),
qw AS (
  SELECT subject_id, {}
  FROM qm GROUP BY 1)""".format(", ".join(
    f"max({m}) FILTER (WHERE compartment = '{c}') AS \"{c}_{m}\""
    for m in ("dice", "hd95_mm") for c in ("WT", "TC", "ET")))
WIDE = [f"{c}_{m}" for m in ("dice", "hd95_mm") for c in ("WT", "TC", "ET")]


def gt_quality(spark, folder):
    docs = documents(spark, folder).where(F.col("pair_id") == "dl_vs_gt")
    return sidecars.quality_metrics(sidecars.parse_metric_sidecars(docs))


@query("p16_quality_coercion", with_ctes(*DOCUMENT_CTES, QUALITY_SQL, select="""
SELECT subject_id, compartment, dice, hd95_mm FROM qm"""), rounded=["dice", "hd95_mm"])
def p16(spark, folder):
    return gt_quality(spark, folder)


@query("v3_wide_outlier_frame", with_ctes(*DOCUMENT_CTES, QUALITY_SQL, select="SELECT * FROM qw"),
       rounded=WIDE)
def v3(spark, folder):
    return quality.wide_metrics(gt_quality(spark, folder))


def _reasons_sql() -> str:
    parts = []
    for c, floor in (("WT", 0.85), ("TC", 0.75), ("ET", 0.70)):
        d, h = f'"{c}_dice"', f'"{c}_hd95_mm"'
        parts.append(
            f"CASE WHEN {d} IS NULL THEN '{c}_dice_nan' WHEN {d} < {floor}::DOUBLE THEN "
            f"'{c}_dice_lt_{floor:.2f}(' || printf('%.3f', round_even({d}, 3)) || ')' END")
        parts.append(
            f"CASE WHEN {h} IS NULL THEN '{c}_hd95_nan' WHEN isinf({h}) THEN '{c}_hd95_inf' "
            f"WHEN {h} > 20 THEN '{c}_hd95_gt_20mm(' || printf('%.1f', round_even({h}, 1)) || ')' END")
    return ", ".join(parts)


FLAGS_SQL = f"qf AS (SELECT *, concat_ws('; ', {_reasons_sql()}) AS reasons FROM qw)"


@query("p26_outlier_reasons", with_ctes(*DOCUMENT_CTES, QUALITY_SQL, FLAGS_SQL, select="""
SELECT subject_id, reasons <> '' AS flagged, reasons FROM qf"""))
def p26(spark, folder):
    return quality.flag_outliers(gt_quality(spark, folder)).select(
        "subject_id", "flagged", "reasons")


DECISIONS_SQL = """
keep AS (SELECT DISTINCT subject_id FROM cells WHERE CAST(subject_id AS INTEGER) % 4 IN (0, 1)),
excl AS (SELECT DISTINCT subject_id FROM cells WHERE CAST(subject_id AS INTEGER) % 4 IN (1, 2))"""


def decisions(spark, folder):
    subjects = b.cells(spark, folder).select("subject_id").distinct()
    group = F.col("subject_id").cast("int") % 4
    return subjects.where(group.isin(0, 1)), subjects.where(group.isin(1, 2))


@query("j16_adjudication_gaps", with_ctes(*DOCUMENT_CTES, QUALITY_SQL, FLAGS_SQL, DECISIONS_SQL, select="""
SELECT subject_id, 'keep and exclude' AS issue FROM keep SEMI JOIN excl USING (subject_id)
UNION ALL
SELECT subject_id, 'not adjudicated' FROM qf WHERE reasons <> ''
  AND subject_id NOT IN (SELECT subject_id FROM keep) AND subject_id NOT IN (SELECT subject_id FROM excl)"""))
def j16(spark, folder):
    keep, exclude = decisions(spark, folder)
    flagged = quality.flag_outliers(gt_quality(spark, folder))
    return quality.adjudication_gaps(flagged, keep, exclude)


@query("u3_keep_and_exclude", with_ctes(*DOCUMENT_CTES, DECISIONS_SQL, select="""
SELECT subject_id FROM keep INTERSECT SELECT subject_id FROM excl"""))
def u3(spark, folder):
    keep, exclude = decisions(spark, folder)
    return keep.intersect(exclude)


def _quantile_sql(p: float, name: str) -> str:
    """Linear interpolation in which infinity minus infinity never occurs."""
    at = f"{p}::DOUBLE * (n - 1)"
    lo, hi = f"s[floor({at})::INTEGER + 1]", f"s[ceil({at})::INTEGER + 1]"
    return (f"CASE WHEN {lo} = {hi} OR {lo} = '-inf'::DOUBLE THEN {lo} "
            f"ELSE {lo} + ({hi} - {lo}) * ({at} - floor({at})) END AS {name}")


@query("a46_metric_spread", with_ctes(*DOCUMENT_CTES, QUALITY_SQL, """
qs AS (SELECT compartment || '_' || metric AS metric, loose AS value FROM ml
       WHERE pair_id = 'dl_vs_gt' AND metric IN ('dice', 'hd95_mm') AND loose IS NOT NULL),
ql AS (SELECT metric, count(*) AS n, list(value ORDER BY value) AS s, min(value) AS min, max(value) AS max
       FROM qs GROUP BY 1)""", select=f"""
SELECT metric, n, {_quantile_sql(0.25, "q1")}, {_quantile_sql(0.5, "median")},
       {_quantile_sql(0.75, "q3")}, min, max FROM ql"""),
       rounded=["q1", "median", "q3", "min", "max"])
def a46(spark, folder):
    return robust.metric_spread(quality.wide_metrics(gt_quality(spark, folder)), WIDE)


@query("p18_json_safe_encode", with_ctes(*DOCUMENT_CTES, select="""
SELECT subject_id, pair_id, compartment,
  CASE WHEN number IS NULL THEN 'null' WHEN isinf(number) THEN '"inf"'
       ELSE CAST(CAST(number AS BIGINT) AS VARCHAR) || '.0' END AS sidecar_text,
  CASE WHEN number IS NULL OR isinf(number) THEN 'null'
       ELSE CAST(CAST(number AS BIGINT) AS VARCHAR) || '.0' END AS panel_text
FROM pm WHERE metric = 'hd95_mm'"""))
def p18(spark, folder):
    return pair_metrics(spark, folder).select(
        "subject_id", "pair_id", "compartment",
        numbers.json_number(F.col("hd95_mm")).alias("sidecar_text"),
        numbers.json_number(F.col("hd95_mm"), infinity=None).alias("panel_text"))


SUMMARY = """SELECT {keys}, count(*) FILTER (WHERE status = 'ok') AS n_used,
    count(*) FILTER (WHERE status = 'missing') AS n_missing,
    count(*) FILTER (WHERE status = 'inf') AS n_inf,
    quantile_cont(value, 0.25) FILTER (WHERE status = 'ok') AS q1,
    quantile_cont(value, 0.5) FILTER (WHERE status = 'ok') AS median,
    quantile_cont(value, 0.75) FILTER (WHERE status = 'ok') AS q3
  FROM ml GROUP BY ALL"""
FILL = """coalesce(n_used, 0) AS n_used, coalesce(n_missing, 0) AS n_missing,
  coalesce(n_inf, 0) AS n_inf, q1, median, q3"""
S1_SQL = "s1 AS (" + SUMMARY.format(keys="compartment, metric") + ")"
S2_SQL = "s2 AS (" + SUMMARY.format(keys="pair_id, compartment, metric") + f"""),
full2 AS (SELECT pair_id, compartment, metric, digits, {FILL}
          FROM (SELECT * FROM prs, comps, mets) LEFT JOIN s2 USING (pair_id, compartment, metric))"""
QUARTILES = ["q1", "median", "q3"]


@query("a15_robust_cell_summary", with_ctes(*DOCUMENT_CTES, METRICS_SQL, S1_SQL, select=f"""
SELECT compartment, metric, {FILL}
FROM (SELECT * FROM comps, mets) LEFT JOIN s1 USING (compartment, metric)"""), rounded=QUARTILES)
def a15(spark, folder):
    return robust.cell_summary(long(spark, folder))


def by_pair(spark, folder):
    return robust.cell_summary(long(spark, folder), pairs=PAIRS)


@query("a16_all_pairs_summary", with_ctes(*DOCUMENT_CTES, METRICS_SQL, PAIRS_SQL, S2_SQL, select="""
SELECT pair_id, compartment, metric, n_used, n_missing, n_inf, q1, median, q3 FROM full2"""),
       rounded=QUARTILES)
def a16(spark, folder):
    return by_pair(spark, folder)


TOTAL_SQL = "(SELECT count(DISTINCT subject_id) FROM cells)"


def n_subjects(spark, folder):
    return b.cells(spark, folder).select("subject_id").distinct().agg(F.count(F.lit(1)))


@query("a17_denominator_exceptions", with_ctes(*DOCUMENT_CTES, METRICS_SQL, PAIRS_SQL, S2_SQL, select=f"""
SELECT pair_id, compartment, metric, pair_id || '/' || compartment || '/' || metric || ': n='
  || n_used || '/' || {TOTAL_SQL} || ' (missing=' || n_missing || ', inf=' || n_inf || ')' AS note
FROM full2 WHERE n_used <> {TOTAL_SQL}"""))
def a17(spark, folder):
    return robust.denominator_exceptions(by_pair(spark, folder), n_subjects(spark, folder))


@query("a17_denominator_note", with_ctes(*DOCUMENT_CTES, METRICS_SQL, S1_SQL, select="""
SELECT coalesce(string_agg(note, '; ' ORDER BY note), '') AS note FROM (
  SELECT compartment || '/' || metric || ': n=' || coalesce(n_used, 0) || '/' || t.n || ' (missing='
    || coalesce(n_missing, 0) || ', inf=' || coalesce(n_inf, 0) || ')' AS note
  FROM (SELECT * FROM comps, mets) LEFT JOIN s1 USING (compartment, metric),
       (SELECT count(*) AS n FROM docs) t WHERE coalesce(n_used, 0) <> t.n)"""))
def a17_note(spark, folder):
    summary = robust.cell_summary(long(spark, folder))
    total = documents(spark, folder).agg(F.count(F.lit(1)))
    return robust.denominator_note(summary, total)


@query("p27_printed_cells", with_ctes(*DOCUMENT_CTES, METRICS_SQL, PAIRS_SQL, S2_SQL, select="""
SELECT pair_id, compartment, metric, CASE WHEN n_used = 0 THEN '--' ELSE
  CASE digits
    WHEN 3 THEN printf('%.3f [%.3f, %.3f]', round_even(median, 3), round_even(q1, 3), round_even(q3, 3))
    WHEN 2 THEN printf('%.2f [%.2f, %.2f]', round_even(median, 2), round_even(q1, 2), round_even(q3, 2))
    ELSE printf('%.0f [%.0f, %.0f]', round_even(median, 0), round_even(q1, 0), round_even(q3, 0))
  END END AS cell FROM full2"""))
def p27(spark, folder):
    return robust.with_cell_text(by_pair(spark, folder)).select(
        "pair_id", "compartment", "metric", "cell")


@query("o1_audit_order", with_ctes(*DOCUMENT_CTES, select="""
SELECT pair_id, compartment, metric, subject_id, status FROM ml ORDER BY 1, 2, 3, 4"""))
def o1(spark, folder):
    return robust.audit_order(long(spark, folder)).select(
        "pair_id", "compartment", "metric", "subject_id", "status")
