"""Volumes over time over the ``timepoints`` and ``cells`` views."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtally.operators import longitudinal as ops
from voxtally.plans import bindings as b
from voxtally.plans.bindings import CELLS_SQL, LUT_SQL, TIMEPOINTS_SQL, sql_zero_fill, with_ctes
from voxtally.plans.region_queries import matrix
from voxtally.plans.registry import query
from voxtally.session import run_folder
from voxtally.sources import tables

ML = [f"vol_{c}_ml" for c in ("WT", "TC", "ET", "NCR", "ED")]
VOLUMES_ML_SQL = """
SELECT {keys}, count(*) FILTER (WHERE pred IN (1, 2, 4)) * 1.5::DOUBLE / 1000 AS "vol_WT_ml",
  count(*) FILTER (WHERE pred IN (1, 4)) * 1.5::DOUBLE / 1000 AS "vol_TC_ml",
  count(*) FILTER (WHERE pred = 4) * 1.5::DOUBLE / 1000 AS "vol_ET_ml",
  count(*) FILTER (WHERE pred = 1) * 1.5::DOUBLE / 1000 AS "vol_NCR_ml",
  count(*) FILTER (WHERE pred = 2) * 1.5::DOUBLE / 1000 AS "vol_ED_ml"
FROM cells GROUP BY ALL"""


def volumes(spark, folder, keys):
    return ops.volumes_ml(b.cells(spark, folder), keys=keys, label="pred", voxel_mm3=1.5)


@query("a25_compartment_volumes", with_ctes(CELLS_SQL, select=VOLUMES_ML_SQL.format(keys="subject_id")),
       rounded=ML)
def a25(spark, folder):
    return volumes(spark, folder, ["subject_id"])


@query("a25_compartment_volumes_voxel_sizes", with_ctes(CELLS_SQL, select=VOLUMES_ML_SQL.format(
    keys="subject_id").replace("1.5::DOUBLE", "max(1.0::DOUBLE + CAST(subject_id AS INTEGER) % 3 * 0.25)")),
       rounded=ML)
def a25_voxel_sizes(spark, folder):
    size = F.lit(1.0) + F.col("subject_id").cast("int") % 3 * F.lit(0.25)
    return ops.volumes_ml(b.cells(spark, folder), keys=["subject_id"], label="pred", voxel_mm3=size)


PLAN_SQL = f"""
plan AS (SELECT DISTINCT {sql_zero_fill("CAST(l_suppkey // 5 AS VARCHAR)")} AS subject_id,
           l_linenumber AS timepoint, (l_linenumber - 1) * 35 AS days_since_baseline,
           CASE l_linenumber WHEN 1 THEN 'Pre-Op' WHEN 2 THEN 'Post-Op' WHEN 7 THEN 'PD' ELSE 'SD' END AS rano
         FROM lineitem)"""


def plan(spark, folder):
    """The manifest: seven visits per subject."""
    visit = F.col("timepoint")
    return b.cells(spark, folder).select("subject_id", "timepoint").distinct().withColumns({
        "days_since_baseline": (visit - 1) * 35,
        "rano": F.when(visit == 1, "Pre-Op").when(visit == 2, "Post-Op").when(visit == 7, "PD")
        .otherwise("SD"),
    })


@query("a26_longitudinal_summary", with_ctes(CELLS_SQL, PLAN_SQL,
       "v AS (" + VOLUMES_ML_SQL.format(keys="subject_id, timepoint") + ")", select="""
SELECT * FROM plan LEFT JOIN v USING (subject_id, timepoint)
ORDER BY subject_id, days_since_baseline, timepoint"""), rounded=ML)
def a26(spark, folder):
    keys = ["subject_id", "timepoint"]
    return ops.longitudinal_summary(volumes(spark, folder, keys), plan(spark, folder), keys)


@query("a27_curve_peaks", with_ctes(TIMEPOINTS_SQL, """
long AS (SELECT patient_id, timepoint, days_since_baseline, rano, compartment,
    CASE compartment WHEN 'WT' THEN wt WHEN 'TC' THEN tc WHEN 'ET' THEN et WHEN 'ED' THEN ed ELSE ncr END AS v
  FROM tps, (VALUES ('WT'), ('TC'), ('ET'), ('ED'), ('NCR')) AS c(compartment))""", select="""
SELECT patient_id, compartment, timepoint, days_since_baseline, rano, v AS value_ml FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_id, compartment
    ORDER BY v DESC, days_since_baseline, timepoint DESC) AS rn FROM long) WHERE rn = 1"""))
def a27(spark, folder):
    return ops.peaks(b.timepoints(spark, folder))


SURGERY_SQL = """
pre AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id
          ORDER BY days_since_baseline, timepoint) AS rn FROM tps WHERE lower(rano) = 'pre-op') WHERE rn = 1),
post AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id
          ORDER BY days_since_baseline, timepoint) AS rn FROM tps WHERE lower(rano) = 'post-op') WHERE rn = 1)"""


@query("a28_surgery_change", with_ctes(TIMEPOINTS_SQL, SURGERY_SQL, select="""
SELECT p.patient_id, pre.et - post.et AS "postop_ET_drop_ml", post.wt - pre.wt AS "postop_WT_change_ml"
FROM (SELECT DISTINCT patient_id FROM tps) p LEFT JOIN pre USING (patient_id) LEFT JOIN post USING (patient_id)"""))
def a28(spark, folder):
    return ops.surgery_change(b.timepoints(spark, folder))


RECURRENCE_SQL = """
pd AS (SELECT patient_id, min(days_since_baseline) AS pd_day FROM tps WHERE lower(rano) = 'pd' GROUP BY 1),
last_pd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id
   ORDER BY days_since_baseline DESC, timepoint DESC) AS rn FROM tps WHERE lower(rano) = 'pd') WHERE rn = 1),
trough AS (SELECT * FROM (SELECT t.*, row_number() OVER (PARTITION BY t.patient_id
   ORDER BY t.et, t.days_since_baseline, t.timepoint) AS rn
   FROM tps t JOIN pd USING (patient_id) LEFT JOIN post USING (patient_id)
   WHERE (post.patient_id IS NULL OR t.days_since_baseline >= post.days_since_baseline)
     AND t.days_since_baseline < pd_day) WHERE rn = 1)"""


@query("w8_recurrence_trough", with_ctes(TIMEPOINTS_SQL, SURGERY_SQL, RECURRENCE_SQL, select="""
SELECT pd.patient_id, t.et AS "recurrence_ET_trough_ml", t.timepoint AS "recurrence_ET_trough_timepoint"
FROM pd LEFT JOIN trough t USING (patient_id)"""))
def w8(spark, folder):
    return ops.recurrence(b.timepoints(spark, folder)).select(
        "patient_id", "recurrence_ET_trough_ml", "recurrence_ET_trough_timepoint")


@query("w9_recurrence_rise", with_ctes(TIMEPOINTS_SQL, SURGERY_SQL, RECURRENCE_SQL, select="""
SELECT l.patient_id, l.et AS "recurrence_ET_at_last_PD_ml", l.timepoint AS "recurrence_ET_last_PD_timepoint",
       l.et - t.et AS "recurrence_ET_rise_ml" FROM last_pd l LEFT JOIN trough t USING (patient_id)"""))
def w9(spark, folder):
    return ops.recurrence(b.timepoints(spark, folder)).select(
        "patient_id", "recurrence_ET_at_last_PD_ml", "recurrence_ET_last_PD_timepoint",
        "recurrence_ET_rise_ml")


FOLLOW_UP_SQL = """
fu AS (SELECT subject_id, timepoint, label, name, compartment, mm3 / 1000 AS vol_ml, pct FROM (
  SELECT subject_id, timepoint, region AS label, compartment, 100.0::DOUBLE * count(*) FILTER (WHERE hit) / count(*) AS pct,
         count(*) FILTER (WHERE hit) * 1.0::DOUBLE AS mm3
  FROM (SELECT subject_id, timepoint, region, compartment, CASE compartment WHEN 'WT' THEN pred IN (1, 2, 4)
          WHEN 'TC' THEN pred IN (1, 4) ELSE pred = 4 END AS hit
        FROM cells, (VALUES ('WT'), ('TC'), ('ET')) AS v(compartment)) GROUP BY 1, 2, 3, 4) JOIN lut USING (label)),
topk AS (SELECT subject_id, compartment, name, max_ml, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id, compartment ORDER BY max_ml DESC, name) AS rank FROM (
    SELECT subject_id, compartment, name, max(vol_ml) AS max_ml FROM fu WHERE name <> 'Unknown' GROUP BY 1, 2, 3)
  WHERE max_ml > 0) WHERE rank <= 6)"""


def follow_up(spark, folder):
    return matrix(spark, folder, keys=("subject_id", "timepoint"))


@query("w7_top_regions_over_time", with_ctes(CELLS_SQL, LUT_SQL, FOLLOW_UP_SQL, select="SELECT * FROM topk"),
       rounded=["max_ml"])
def w7(spark, folder):
    return ops.top_regions_over_time(follow_up(spark, folder), 6)


@query("v2_region_by_timepoint", with_ctes(CELLS_SQL, LUT_SQL, FOLLOW_UP_SQL, select="""
SELECT t.subject_id, t.compartment, t.name, t.max_ml, t.rank, {}
FROM topk t JOIN fu USING (subject_id, compartment, name) GROUP BY ALL""".format(", ".join(
    f"coalesce(max(vol_ml) FILTER (WHERE timepoint = {i}), 0) AS tp_{i}" for i in range(1, 8)))),
       rounded=["max_ml", *[f"tp_{i}" for i in range(1, 8)]])
def v2(spark, folder):
    return ops.region_by_timepoint(follow_up(spark, folder), range(1, 8), 6)


@query("a45_timepoint_totals", with_ctes(CELLS_SQL, LUT_SQL, FOLLOW_UP_SQL, select="""
SELECT subject_id, timepoint, compartment, sum(vol_ml) AS total_ml,
       coalesce(sum(vol_ml) FILTER (WHERE name <> 'Unknown'), 0) AS total_named_ml
FROM fu GROUP BY 1, 2, 3"""), rounded=["total_ml", "total_named_ml"])
def a45(spark, folder):
    return ops.timepoint_totals(follow_up(spark, folder))


@query("j7_manifest_status", with_ctes(TIMEPOINTS_SQL, select="""
SELECT patient_id, timepoint, days_since_baseline, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE wt END AS "vol_WT_ml",
       CASE WHEN o_orderkey % 3 = 0 THEN 'missing' ELSE 'ok' END AS status FROM tps"""))
def j7(spark, folder):
    rows = b.timepoints(spark, folder)
    number = F.regexp_extract("timepoint", r"(\d+)$", 1).cast("bigint")
    written = rows.where(number % 3 != 0).select("patient_id", "timepoint", "vol_WT_ml")
    manifest = rows.select("patient_id", "timepoint", "days_since_baseline")
    return ops.manifest_status(manifest, written, ["patient_id", "timepoint"])


@query("j8_response_override", with_ctes(TIMEPOINTS_SQL, select="""
SELECT patient_id, timepoint,
  CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 THEN 'CR' ELSE rano END AS rano,
  CASE WHEN o_orderkey % 2 = 0 THEN 'why ' || o_orderstatus ELSE '' END AS rano_rationale FROM tps"""))
def j8(spark, folder):
    rows = b.timepoints(spark, folder).select("patient_id", "timepoint", "rano")
    k = F.col("o_orderkey")
    manifest = b.table(spark, folder, "orders").where(k % 2 == 0).select(
        b._subject(F.col("o_custkey")).alias("patient_id"),
        F.concat(F.lit("tp-"), k.cast("string")).alias("timepoint"),
        F.when(k % 5 == 0, F.lit(" ")).otherwise(F.lit(" CR ")).alias("rano"),
        F.concat(F.lit(" why "), F.col("o_orderstatus"), F.lit(" ")).alias("rano_rationale"),
    )
    return ops.merge_response(rows, manifest, ["patient_id", "timepoint"])


@query("j9_scanner_lookup", f"""
WITH scans AS (
  SELECT {sql_zero_fill("CAST(l_suppkey // 5 AS VARCHAR)")} AS patient_id, l_linenumber AS tp,
    CASE l_returnflag WHEN 'R' THEN 't1' WHEN 'A' THEN 'ct1' ELSE 'flair' END AS seq,
    CASE l_partkey % 4 WHEN 0 THEN 'Siemens' WHEN 1 THEN 'GE' WHEN 2 THEN 'Philips' END AS manufacturer,
    'model ' || (l_partkey % 9) AS model, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE '1x1x1' END AS voxel_size,
    l_orderkey, l_partkey FROM lineitem),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, tp, seq
            ORDER BY l_orderkey, l_partkey) AS rn FROM scans) WHERE rn = 1)
SELECT s.patient_id, 'Week-' || s.tp AS timepoint, c.channel, coalesce(f.manufacturer, '?') AS manufacturer,
       coalesce(f.model, '?') AS model, coalesce(nullif(f.voxel_size, ''), '?') AS voxel_size
FROM (SELECT DISTINCT patient_id, tp FROM scans) s
  CROSS JOIN (VALUES ('T1'), ('CT1'), ('T2'), ('FLAIR')) AS c(channel)
  LEFT JOIN first f ON f.patient_id = s.patient_id AND f.tp = s.tp AND f.seq = lower(c.channel)""")
def j9(spark, folder):
    part = F.col("l_partkey")
    scans = b.table(spark, folder, "lineitem").select(
        F.concat(F.lit(" "), b._subject(F.floor(F.col("l_suppkey") / 5))).alias("patient_id"),
        F.concat(F.lit("WEEK-"), F.col("l_linenumber").cast("string")).alias("timepoint"),
        F.when(F.col("l_returnflag") == "R", "T1").when(F.col("l_returnflag") == "A", " ct1 ")
        .otherwise("Flair").alias("sequence"),
        F.when(part % 4 == 0, " Siemens").when(part % 4 == 1, "GE").when(part % 4 == 2, "Philips")
        .alias("manufacturer"),
        F.concat(F.lit("model "), (part % 9).cast("string")).alias("model"),
        F.when(part % 5 == 0, "").otherwise("1x1x1").alias("voxel_size"),
        "l_orderkey", part,
    )
    visits = b.cells(spark, folder).select(
        F.col("subject_id").alias("patient_id"),
        F.concat(F.lit("Week-"), F.col("timepoint").cast("string")).alias("timepoint"))
    return ops.scanner_per_channel(visits, scans, order=["l_orderkey", "l_partkey"])


DRIFT_SQL = f"""
WITH m AS (
  SELECT {sql_zero_fill("CAST(c_custkey AS VARCHAR)")} AS patient_id, c_custkey AS k,
    CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, CAST(30 + c_custkey % 40 AS INTEGER) AS age,
    CASE WHEN c_custkey % 3 = 0 THEN 'mutant' ELSE 'WT' END AS idh, 'methylated' AS mgmt_qualitative,
    (c_custkey % 90)::DOUBLE AS mgmt_pct, CAST(floor(abs(c_acctbal)) AS BIGINT) AS survival FROM customer),
s AS (SELECT *,
    CASE WHEN k % 11 = 0 THEN 'male' ELSE CASE sex WHEN 'F' THEN ' Female' ELSE 'male' END END AS sex_s,
    CASE WHEN k % 13 = 0 THEN 'n/a' WHEN k % 17 = 0 THEN CAST(age + 1 AS VARCHAR) || '.0' ELSE CAST(age AS VARCHAR) || '.7' END AS age_s,
    CASE WHEN k % 4 = 0 THEN 'IDH1 neg, Sequencing required' ELSE 'IDH1 pos' END AS idh_s,
    CASE WHEN k % 5 = 0 THEN 'unmethylated' ELSE ' Methylated ' END AS mgmt_s,
    CASE WHEN k % 7 = 0 THEN CAST(k % 90 AS VARCHAR) || '.5%' ELSE CAST(k % 90 AS VARCHAR) || '.0005%' END AS pct_s,
    CAST(survival AS VARCHAR) AS survival_s FROM m WHERE k % 19 <> 0),
f AS (
  SELECT patient_id, 'row' AS field, NULL AS manifest_value, NULL AS source_value, 'no row' AS problem
  FROM m WHERE k % 19 = 0
  UNION ALL SELECT patient_id, 'sex', sex, sex_s, CASE WHEN lower(substr(trim(sex_s), 1, 1)) <> lower(sex) THEN 'differs' END FROM s
  UNION ALL SELECT patient_id, 'age', CAST(age AS VARCHAR), age_s, CASE WHEN age_s = 'n/a' THEN 'unparseable'
    WHEN k % 17 = 0 THEN 'differs' END FROM s
  UNION ALL SELECT patient_id, 'idh', idh, idh_s, CASE WHEN idh = 'WT' AND k % 4 <> 0 THEN 'differs' END FROM s
  UNION ALL SELECT patient_id, 'mgmt_qualitative', mgmt_qualitative, mgmt_s, CASE WHEN k % 5 = 0 THEN 'differs' END FROM s
  UNION ALL SELECT patient_id, 'mgmt_pct', CAST(CAST(mgmt_pct AS BIGINT) AS VARCHAR) || '.0', pct_s, CASE WHEN k % 7 = 0 THEN 'differs' END FROM s)
SELECT patient_id, field, manifest_value, source_value, problem FROM f WHERE problem IS NOT NULL"""


@query("j10_manifest_drift", DRIFT_SQL)
def j10(spark, folder):
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    age, pct = (30 + k % 40), (k % 90)
    rows = b.table(spark, folder, "customer")
    female = k % 2 == 0
    manifest = rows.select(
        b._subject(k).alias("patient_id"),
        F.when(female, "F").otherwise("M").alias("sex"), age.cast("int").alias("age"),
        F.when(k % 3 == 0, "mutant").otherwise("WT").alias("idh"),
        F.lit("methylated").alias("mgmt_qualitative"), pct.cast("double").alias("mgmt_pct"),
        F.floor(F.abs("c_acctbal")).cast("bigint").alias("survival"),
    )
    source = rows.where(k % 19 != 0).select(
        F.concat(F.lit(" "), b._subject(k)).alias("patient_id"),
        F.when(k % 11 == 0, "male").otherwise(F.when(female, " Female").otherwise("male")).alias("sex"),
        F.when(k % 13 == 0, "n/a").when(k % 17 == 0, F.concat(text(age + 1), F.lit(".0")))
        .otherwise(F.concat(text(age), F.lit(".7"))).alias("age"),
        F.when(k % 4 == 0, "IDH1 neg, Sequencing required").otherwise("IDH1 pos").alias("idh"),
        F.when(k % 5 == 0, "unmethylated").otherwise(" Methylated ").alias("mgmt_qualitative"),
        F.when(k % 7 == 0, F.concat(text(pct), F.lit(".5%")))
        .otherwise(F.concat(text(pct), F.lit(".0005%"))).alias("mgmt_pct"),
        text(F.floor(F.abs("c_acctbal")).cast("bigint")).alias("survival"),
        k.alias("line"),
    )
    return ops.drift(manifest, source, ["patient_id"], {
        "sex": ops.initial_rule, "age": ops.integer_rule, "idh": ops.wild_type_rule,
        "mgmt_qualitative": ops.text_rule, "mgmt_pct": ops.percent_rule,
        "survival": ops.integer_rule,
    }, order=["line"])


@query("j10_response_drift", with_ctes(TIMEPOINTS_SQL, select="""
SELECT patient_id, timepoint, field, manifest_value, source_value, problem FROM (
  SELECT patient_id, timepoint, 'row' AS field, NULL AS manifest_value, NULL AS source_value, 'no row' AS problem
  FROM tps WHERE o_orderkey % 10 = 0
  UNION ALL
  SELECT patient_id, timepoint, 'rano', rano, 'PD', 'differs' FROM tps
  WHERE o_orderkey % 10 = 1 AND lower(rano) <> 'pd')"""))
def j10_response(spark, folder):
    rows = b.timepoints(spark, folder).select("patient_id", "timepoint", "rano")
    number = F.regexp_extract("timepoint", r"(\d+)$", 1).cast("bigint")
    source = rows.where(number % 10 != 0).select(
        "patient_id", F.upper("timepoint").alias("timepoint"),
        F.when(number % 10 == 1, "PD").otherwise(F.lower("rano")).alias("rano"),
        number.alias("line"))
    return ops.drift(rows, source, ["patient_id", "timepoint"], {"rano": ops.text_rule},
                     order=["line"], keep="last")


@query("j10_rationale_drift", with_ctes(TIMEPOINTS_SQL, """
r AS (
  SELECT patient_id, timepoint, rano, o_orderkey % 7 AS m, o_orderkey % 10 AS d,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'growth, new lesion "' || o_orderkey % 4 || '"' END AS why FROM tps)""", select="""
SELECT patient_id, timepoint, 'row' AS field, NULL AS manifest_value, NULL AS source_value, 'no row' AS problem FROM r WHERE d = 0
UNION ALL
SELECT patient_id, timepoint, 'rano', nullif(rano, ''), 'PD', 'differs' FROM r WHERE d = 1 AND lower(rano) <> 'pd'
UNION ALL
SELECT patient_id, timepoint, 'rano_rationale', nullif(why, ''), 'other, reading', 'differs' FROM r WHERE d <> 0 AND m = 2"""))
def j10_rationale(spark, folder):
    """Ratings and their rationale against a CSV with long titles, written and read."""
    number = F.regexp_extract("timepoint", r"(\d+)$", 1).cast("bigint")
    why = F.when(number % 3 == 0, None).otherwise(
        F.concat(F.lit('growth, new lesion "'), (number % 4).cast("string"), F.lit('"')))
    rows = b.timepoints(spark, folder).select(
        "patient_id", "timepoint", F.nullif(F.col("rano"), F.lit("")).alias("rano"), why.alias("rano_rationale"))
    path = run_folder(spark, "ratings")
    rows.where(number % 10 != 0).select(
        F.col("patient_id").alias("Patient"), F.upper("timepoint").alias("Date"),
        F.when(number % 10 == 1, "PD").otherwise(F.lower("rano")).alias(
            "Rating (according to RANO, PD: progressive disease, SD: stable disease)"),
        F.when(number % 7 == 2, "other, reading").otherwise(F.upper("rano_rationale")).alias(
            "Rating rationale (CRET: contrast-enhancing, T2-Progr.: T2 progression)"),
        number.alias("Line")).write.csv(path, header=True, escape='"')
    return ops.drift(rows, tables.read_ratings(spark, path), ["patient_id", "timepoint"],
                     {"rano": ops.text_rule, "rano_rationale": ops.text_rule}, order=["line"], keep="last")
