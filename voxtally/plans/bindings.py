"""Views of the given tables in the shapes the operators take.

Every view has two spellings: a Spark function ``(spark, folder) -> DataFrame`` and an
SQL common table expression. All of them cover their whole source table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.constants import CORTICAL_STEMS, SUBCORTICAL_NAMES, UNMAPPED_NAMES
from voxtally.functions.columns import computed_once
from voxtally.functions.text import zero_fill

REGIONS = 180


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


PARENTS_PER_TASK = 400


def spread(df: DataFrame) -> DataFrame:
    """Deal a few parent rows over all cores before each is expanded into many voxels.

    The number of tasks grows with the rows, so that what one task expands does not.
    """
    tasks = -(-df.count() // PARENTS_PER_TASK)
    return df.repartition(max(8, df.sparkSession.sparkContext.defaultParallelism, tasks))


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select.strip()


def sql_zero_fill(text: str, width: int = 4) -> str:
    return f"CASE WHEN length({text}) >= {width} THEN {text} ELSE lpad({text}, {width}, '0') END"


# --------------------------------------------------------------------------- lookup

def region_names() -> list[tuple[int, str]]:
    """Lookup table by rule: prefixed cortical stems, sided subcortical names, the rest."""
    stems = [s for group in CORTICAL_STEMS.values() for s in group]
    sided = [n for group in SUBCORTICAL_NAMES.values() for n in group if n != "Brain-Stem"]
    names = [f"{prefix}{s}" for prefix in ("ctx-lh-", "ctx-rh-", "wm-lh-", "wm-rh-") for s in stems]
    names += [f"{side}{n}" for side in ("Left-", "Right-") for n in sided]
    names += ["Brain-Stem"]
    names += [n for n in UNMAPPED_NAMES if n != "Unknown"]
    return [(0, "Unknown"), *enumerate(names, start=1)]


def lut(spark: SparkSession, folder: str | None = None) -> DataFrame:
    return spark.createDataFrame(region_names(), "label INT, name STRING")


LUT_SQL = "lut(label, name) AS (VALUES {})".format(
    ", ".join(f"({i}, '{n}')" for i, n in region_names())
)


# --------------------------------------------------------------------------- cells

def _subject(number: Column) -> Column:
    return zero_fill(number.cast("string"))


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Co-registered voxels: region, two label maps, a raw code and three probabilities."""
    line = table(spark, folder, "lineitem")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    pred = (
        F.when(flag == "R", 4)
        .when((flag == "A") & (status == "F"), 1)
        .when((flag == "A") & (status == "O"), 2)
        .otherwise(0)
    )
    moved = F.when(F.col("pred") == 4, 2).when(F.col("pred") == 2, 0).when(
        F.col("pred") == 1, 4).otherwise(1)
    wt = F.col("l_discount") * 10.0
    return (
        line.select(
            _subject(F.floor(F.col("l_suppkey") / 5)).alias("subject_id"),
            (F.col("l_partkey") % REGIONS).cast("int").alias("region"),
            pred.alias("pred"),
            (F.col("l_linenumber") % 4).alias("raw"),
            F.col("l_linenumber").alias("timepoint"),
            F.col("l_tax"),
            F.array(wt * 0.6, wt, wt * 0.3).alias("p"),
        )
        .withColumn("ref", F.when(F.col("l_tax") >= 0.07, moved).otherwise(F.col("pred")))
        .drop("l_tax")
    )


CELLS_SQL = f"""
cells0 AS (
  SELECT CAST(l_suppkey // 5 AS VARCHAR) AS s, CAST(l_partkey % {REGIONS} AS INTEGER) AS region,
         CASE WHEN l_returnflag = 'R' THEN 4
              WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 1
              WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 2 ELSE 0 END AS pred,
         l_linenumber % 4 AS raw, l_linenumber AS timepoint, l_tax,
         l_discount * 10.0::DOUBLE AS wt
  FROM lineitem),
cells AS (
  SELECT {sql_zero_fill("s")} AS subject_id, region, pred, raw, timepoint,
         CASE WHEN l_tax >= 0.07::DOUBLE THEN
              CASE pred WHEN 4 THEN 2 WHEN 2 THEN 0 WHEN 1 THEN 4 ELSE 1 END
              ELSE pred END AS ref,
         wt * 0.6::DOUBLE AS p_tc, wt AS p_wt, wt * 0.3::DOUBLE AS p_et
  FROM cells0)
"""

COMPARTMENTS_SQL = "comps(compartment, c) AS (VALUES ('WT', 1), ('TC', 2), ('ET', 3))"


def sql_in(label: str, compartment: str) -> str:
    codes = {"WT": "(1, 2, 4)", "TC": "(1, 4)", "ET": "(4)"}[compartment]
    return f"({label} IN {codes})"


def sql_masked(label: str, compartment: str = "compartment") -> str:
    return (
        f"CASE {compartment} WHEN 'WT' THEN {label} IN (1, 2, 4) "
        f"WHEN 'TC' THEN {label} IN (1, 4) ELSE {label} = 4 END"
    )


def matrix_sql(name: str = "matrix", label: str = "pred") -> str:
    """CTE of the region matrix for one label column of ``cells``."""
    return f"""
{name}_n AS (
  SELECT subject_id, region AS label, count(*) AS parcel_voxels,
         count(*) FILTER (WHERE {sql_in(label, 'WT')}) AS n_wt,
         count(*) FILTER (WHERE {sql_in(label, 'TC')}) AS n_tc,
         count(*) FILTER (WHERE {sql_in(label, 'ET')}) AS n_et
  FROM cells GROUP BY 1, 2),
{name}_l AS (
  SELECT subject_id, label, parcel_voxels, compartment,
         CASE compartment WHEN 'WT' THEN n_wt WHEN 'TC' THEN n_tc ELSE n_et END AS overlap_voxels
  FROM {name}_n, (VALUES ('WT'), ('TC'), ('ET')) AS v(compartment)),
{name}_t AS (
  SELECT subject_id, compartment, CAST(sum(overlap_voxels) AS BIGINT) AS compartment_voxels
  FROM {name}_l GROUP BY 1, 2),
{name} AS (
  SELECT l.subject_id, l.label, lut.name, l.compartment, l.parcel_voxels, t.compartment_voxels,
         l.overlap_voxels, l.overlap_voxels * 1.0::DOUBLE AS overlap_volume_mm3,
         100.0::DOUBLE * l.overlap_voxels / l.parcel_voxels AS pct_of_parcel,
         CASE WHEN t.compartment_voxels > 0
              THEN 100.0::DOUBLE * l.overlap_voxels / t.compartment_voxels END AS pct_of_compartment
  FROM {name}_l l JOIN {name}_t t USING (subject_id, compartment) JOIN lut USING (label))
"""


# --------------------------------------------------------------------------- volumes

SHAPE = 24


def volumes(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse voxels of two nested ellipsoid maps per supplier on a 24^3 grid.

    Some maps miss the innermost class, and some carry one stray voxel far away.
    """
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    base = spread(table(spark, folder, "supplier")).select(
        k.cast("int").alias("k"), n.alias("n"),
        (8 + k % 7).cast("int").alias("cx"), (9 + n % 6).cast("int").alias("cy"),
        (10 + F.floor(k / 7) % 5).cast("int").alias("cz"),
        (4 + k % 3).cast("int").alias("r"), (4 + F.floor(k / 3) % 3).cast("int").alias("q"),
        (k % 3).cast("int").alias("dx"), (n % 2).cast("int").alias("dy"),
        ((k + n) % 2).cast("int").alias("dz"),
    )
    # Squared distances grow axis by axis, so whole columns of the grid drop out early.
    base = base.withColumns({"dp": F.lit(0), "dr": F.lit(0)})
    inside = (F.col("dp") <= F.col("r") * F.col("r")) | (F.col("dr") <= F.col("q") * F.col("q"))
    stray = F.col("k") % 4 == 0
    for axis, weight in (("x", 1), ("y", 1), ("z", 2)):
        span = F.sequence(F.col(f"c{axis}") - 7, F.col(f"c{axis}") + 9)
        here = F.col(axis)
        d_pred, d_ref = here - F.col(f"c{axis}"), here - F.col(f"c{axis}") - F.col(f"d{axis}")
        stray = stray & (here == 0)
        base = computed_once(
            base.withColumn(axis, F.explode(F.concat(F.array(F.lit(0)), span))),
            {"dp": F.col("dp") + weight * d_pred * d_pred, "dr": F.col("dr") + weight * d_ref * d_ref},
        ).where(inside | stray)
    r, q, dp, dr = (F.col(c) for c in ("r", "q", "dp", "dr"))
    pred = (
        F.when(stray, 2)
        .when((dp <= (r - 2) * (r - 2)) & (F.col("k") % 10 != 0), 4)
        .when(dp <= (r - 1) * (r - 1), 1)
        .when(dp <= r * r, 2)
        .otherwise(0)
    )
    ref = (
        F.when((dr <= (q - 2) * (q - 2)) & (F.col("k") % 5 != 0), 4)
        .when(dr <= (q - 1) * (q - 1), 1)
        .when(dr <= q * q, 2)
        .otherwise(0)
    )
    labelled = base.withColumn("subject_id", _subject(F.col("k")))
    return computed_once(labelled, {"pred": pred, "ref": ref}).select(
        "subject_id", "x", "y", "z", "pred", "ref").where((F.col("pred") > 0) | (F.col("ref") > 0))


def grids(spark: SparkSession, folder: str) -> DataFrame:
    """Shape and spacing of every volume; some spacings are anisotropic."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    sx = 1.0 + 0.5 * (n % 3)
    zero = F.lit(0.0)
    row = lambda *v: F.array(*v)
    return table(spark, folder, "supplier").select(
        _subject(k).alias("subject_id"),
        F.array(*[F.lit(SHAPE)] * 3).alias("shape"),
        F.array(sx, F.lit(1.0), F.lit(2.0)).alias("voxel_size_mm"),
        F.when(k % 9 == 0, "LPS").otherwise("RAS").alias("axcodes"),
        F.array(
            row(-sx, zero, zero, F.lit(10.0)), row(zero, F.lit(1.0), zero, F.lit(-5.0)),
            row(zero, zero, F.lit(2.0), zero), row(zero, zero, zero, F.lit(1.0)),
        ).alias("affine"),
    )


VOLUMES_SQL = f"""
span AS (SELECT k, n, x, cx, y, cy, z, cz, r, q, dx, dy, dz FROM (
  SELECT CAST(s_suppkey AS INTEGER) AS k, s_nationkey AS n,
         8 + s_suppkey % 7 AS cx, 9 + s_nationkey % 6 AS cy, 10 + (s_suppkey // 7) % 5 AS cz,
         4 + s_suppkey % 3 AS r, 4 + (s_suppkey // 3) % 3 AS q,
         s_suppkey % 3 AS dx, s_nationkey % 2 AS dy, (s_suppkey + s_nationkey) % 2 AS dz
  FROM supplier),
  (SELECT CAST(range AS INTEGER) AS x FROM range({SHAPE})),
  (SELECT CAST(range AS INTEGER) AS y FROM range({SHAPE})),
  (SELECT CAST(range AS INTEGER) AS z FROM range({SHAPE}))),
dist AS (
  SELECT *, (x-cx)*(x-cx) + (y-cy)*(y-cy) + 2*(z-cz)*(z-cz) AS dp,
         (x-cx-dx)*(x-cx-dx) + (y-cy-dy)*(y-cy-dy) + 2*(z-cz-dz)*(z-cz-dz) AS dr
  FROM span),
volumes AS (
  SELECT {sql_zero_fill("CAST(k AS VARCHAR)")} AS subject_id, x, y, z, pred, ref FROM (
    SELECT *,
      CASE WHEN k % 4 = 0 AND x = 0 AND y = 0 AND z = 0 THEN 2
           WHEN dp <= (r-2)*(r-2) AND k % 10 <> 0 THEN 4
           WHEN dp <= (r-1)*(r-1) THEN 1 WHEN dp <= r*r THEN 2 ELSE 0 END AS pred,
      CASE WHEN dr <= (q-2)*(q-2) AND k % 5 <> 0 THEN 4
           WHEN dr <= (q-1)*(q-1) THEN 1 WHEN dr <= q*q THEN 2 ELSE 0 END AS ref
    FROM dist)
  WHERE pred > 0 OR ref > 0),
grids AS (
  SELECT {sql_zero_fill("CAST(s_suppkey AS VARCHAR)")} AS subject_id,
         {SHAPE} AS nx, {SHAPE} AS ny, {SHAPE} AS nz,
         1.0::DOUBLE + 0.5::DOUBLE * (s_nationkey % 3) AS sx, 1.0::DOUBLE AS sy, 2.0::DOUBLE AS sz,
         CASE WHEN s_suppkey % 9 = 0 THEN 'LPS' ELSE 'RAS' END AS axcodes
  FROM supplier)
"""


# --------------------------------------------------------------------------- intensities

SIDE = 8
CHANNELS = ("T1", "T1c", "T2", "FLAIR")


def intensity(spark: SparkSession, folder: str) -> DataFrame:
    """Dense four-channel volumes of 8^3 voxels per supplier, zero outside a ball.

    Some channels are constant inside the ball, some are zero everywhere.
    """
    k = F.col("s_suppkey")
    base = spread(table(spark, folder, "supplier")).select(
        k.cast("int").alias("k"), _subject(k).alias("subject_id"),
        F.posexplode(F.array(*[F.lit(c) for c in CHANNELS])).alias("c", "channel"),
    )
    for axis in "xyz":
        base = base.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))))
    x, y, z, c, k = (F.col(name) for name in "xyzck")
    inside = (x - 4) * (x - 4) + (y - 4) * (y - 4) + (z - 3) * (z - 3) <= 9
    value = (
        F.when(~inside | ((k % 11 == 0) & (c == 2)), 0)
        .when((k % 10 == 0) & (c == 3), 5)
        .otherwise((x * 7 + y * 13 + z * 29 + k * 31 + c * 17) % 97)
    )
    mask = (x - 3) * (x - 3) + (y - 4) * (y - 4) + (z - 3) * (z - 3) <= 4
    return base.select(
        "subject_id", "channel", "x", "y", "z", value.cast("double").alias("v"),
        mask.alias("in_mask"),
    )


INTENSITY_SQL = f"""
intensity AS (
  SELECT {sql_zero_fill("CAST(k AS VARCHAR)")} AS subject_id, channel, x, y, z,
    CAST(CASE WHEN (x-4)*(x-4) + (y-4)*(y-4) + (z-3)*(z-3) > 9 OR (k % 11 = 0 AND c = 2) THEN 0
              WHEN k % 10 = 0 AND c = 3 THEN 5
              ELSE (x*7 + y*13 + z*29 + k*31 + c*17) % 97 END AS DOUBLE) AS v,
    (x-3)*(x-3) + (y-4)*(y-4) + (z-3)*(z-3) <= 4 AS in_mask
  FROM (SELECT CAST(s_suppkey AS INTEGER) AS k FROM supplier),
       (VALUES ('T1', 0), ('T1c', 1), ('T2', 2), ('FLAIR', 3)) AS ch(channel, c),
       (SELECT CAST(range AS INTEGER) AS x FROM range({SIDE})),
       (SELECT CAST(range AS INTEGER) AS y FROM range({SIDE})),
       (SELECT CAST(range AS INTEGER) AS z FROM range({SIDE})))
"""


# --------------------------------------------------------------------------- cohort

def cohort(spark: SparkSession, folder: str) -> DataFrame:
    """Clinical metadata as read from a header file: every column is text."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    exam = F.concat(F.lit("UCSF-PDGM-"), zero_fill(k.cast("string"), 3))
    split = F.when(k % 6 == 0, "Training").when(k % 6 == 1, "Validation").when(k % 6 == 2, "Test")
    days = F.floor(F.abs("c_acctbal")).cast("long").cast("string")
    return table(spark, folder, "customer").select(
        F.when(k % 13 == 0, F.concat(exam, F.lit("_FU012d"))).otherwise(exam).alias("ID"),
        F.when(k % 5 < 3, "M").otherwise("F").alias("Sex"),
        (30 + k % 50).cast("string").alias("Age at MRI"),
        F.when(n % 4 == 0, "3").otherwise(" 4 ").alias("WHO CNS Grade"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"),
               "Glioblastoma, IDH-wildtype").otherwise("Astrocytoma, IDH-mutant")
        .alias("Final pathologic diagnosis (WHO 2021)"),
        F.when(k % 4 == 0, "positive").when(k % 4 == 1, "indeterminate").otherwise("negative")
        .alias("MGMT status"),
        F.when(n % 8 == 7, "IDH1 p.R132H").otherwise("wildtype").alias("IDH"),
        (k % 2).cast("string").alias("1-dead 0-alive"),
        F.when(k % 17 == 0, "NA").otherwise(days).alias("OS"),
        F.when(k % 3 == 0, "GTR").when(k % 3 == 1, "STR").otherwise("biopsy").alias("EOR"),
        F.when(n % 7 == 0, "Yes").otherwise("No").alias("Biopsy prior to imaging"),
        split.alias("BraTS21 Segmentation Cohort"),
    )


COHORT_SQL = f"""
cohort AS (
  SELECT 'UCSF-PDGM-' || {sql_zero_fill("CAST(c_custkey AS VARCHAR)", 3)}
           || CASE WHEN c_custkey % 13 = 0 THEN '_FU012d' ELSE '' END AS exam,
    CASE WHEN c_custkey % 5 < 3 THEN 'M' ELSE 'F' END AS sex,
    CAST(30 + c_custkey % 50 AS VARCHAR) AS age,
    CASE WHEN c_nationkey % 4 = 0 THEN '3' ELSE ' 4 ' END AS grade,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
         THEN 'Glioblastoma, IDH-wildtype' ELSE 'Astrocytoma, IDH-mutant' END AS diagnosis,
    CASE c_custkey % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'indeterminate' ELSE 'negative' END AS mgmt,
    CASE WHEN c_nationkey % 8 = 7 THEN 'IDH1 p.R132H' ELSE 'wildtype' END AS idh,
    CAST(c_custkey % 2 AS VARCHAR) AS dead,
    CASE WHEN c_custkey % 17 = 0 THEN 'NA'
         ELSE CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR) END AS os,
    CASE c_custkey % 3 WHEN 0 THEN 'GTR' WHEN 1 THEN 'STR' ELSE 'biopsy' END AS eor,
    CASE WHEN c_nationkey % 7 = 0 THEN 'Yes' ELSE 'No' END AS biopsy,
    CASE c_custkey % 6 WHEN 0 THEN 'Training' WHEN 1 THEN 'Validation' WHEN 2 THEN 'Test' END AS split
  FROM customer),
baseline AS (
  SELECT *, {sql_zero_fill("number")} AS subject_id FROM (
    SELECT *, regexp_extract(exam, '^UCSF-PDGM-([0-9]+)$', 1) AS number FROM cohort)
  WHERE number <> ''),
available AS (
  SELECT DISTINCT id AS subject_id FROM (
    SELECT regexp_extract('cohort/UCSF-PDGM-' || {sql_zero_fill("CAST(o_custkey AS VARCHAR)")}
             || '_nifti/', 'UCSF-PDGM-([0-9]{{4}})_nifti', 1) AS id FROM orders)
  WHERE id <> ''),
pool AS (
  SELECT b.*, CAST(os AS BIGINT) AS os_days FROM baseline b SEMI JOIN available USING (subject_id)
  WHERE trim(diagnosis) = 'Glioblastoma, IDH-wildtype' AND trim(grade) = '4'
    AND trim(idh) = 'wildtype' AND trim(biopsy) = 'No' AND regexp_matches(os, '^[0-9]+$')
    AND trim(coalesce(split, '')) <> 'Training'),
ordered AS (
  SELECT os_days, row_number() OVER (ORDER BY os_days) - 1 AS rn, count(*) OVER () AS n FROM pool),
cuts AS (
  SELECT max(os_days) FILTER (WHERE rn = n // 3) AS t_low,
         max(os_days) FILTER (WHERE rn = (2 * n) // 3) AS t_high, CAST(max(n) AS BIGINT) AS n_pool
  FROM ordered),
binned AS (
  SELECT pool.*, CASE WHEN os_days <= t_low THEN 'short' WHEN os_days <= t_high THEN 'mid'
                      ELSE 'long' END AS tertile
  FROM pool, cuts)
"""


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """A directory listing, one line per order: the exam folders that exist."""
    return table(spark, folder, "orders").select(
        F.concat(F.lit("cohort/UCSF-PDGM-"), zero_fill(F.col("o_custkey").cast("string")),
                 F.lit("_nifti/")).alias("value")
    )


# --------------------------------------------------------------------------- timepoints

def timepoints(spark: SparkSession, folder: str) -> DataFrame:
    """Longitudinal volumes: one row per order, the customer is the patient."""
    k = F.col("o_orderkey")
    priority = F.substring("o_orderpriority", 1, 1)
    rano = (
        F.when(priority == "1", "Pre-Op").when(priority == "2", "Post-Op")
        .when(priority == "3", "PD")
        .otherwise(F.when(F.col("o_orderstatus") == "F", "SD").otherwise(""))
    )
    wt = F.col("o_totalprice") / 1000.0
    tc = wt * ((1 + k % 7) / 10.0)
    et = tc * ((k % 5) / 8.0)
    return table(spark, folder, "orders").select(
        _subject(F.col("o_custkey")).alias("patient_id"),
        F.concat(F.lit("tp-"), k.cast("string")).alias("timepoint"),
        F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).alias("days_since_baseline"),
        rano.alias("rano"),
        wt.alias("vol_WT_ml"), tc.alias("vol_TC_ml"), et.alias("vol_ET_ml"),
        (tc - et).alias("vol_NCR_ml"), (wt - tc).alias("vol_ED_ml"),
    )


TIMEPOINTS_SQL = f"""
tp0 AS (
  SELECT {sql_zero_fill("CAST(o_custkey AS VARCHAR)")} AS patient_id,
    'tp-' || CAST(o_orderkey AS VARCHAR) AS timepoint, o_orderkey, o_orderstatus,
    CAST(date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS INTEGER) AS days_since_baseline,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Pre-Op' WHEN '2' THEN 'Post-Op'
         WHEN '3' THEN 'PD' ELSE CASE WHEN o_orderstatus = 'F' THEN 'SD' ELSE '' END END AS rano,
    o_totalprice / 1000.0::DOUBLE AS wt,
    (o_totalprice / 1000.0::DOUBLE) * ((1 + o_orderkey % 7) / 10.0::DOUBLE) AS tc
  FROM orders),
tps AS (
  SELECT *, tc * ((o_orderkey % 5) / 8.0::DOUBLE) AS et,
         tc - tc * ((o_orderkey % 5) / 8.0::DOUBLE) AS ncr, wt - tc AS ed
  FROM tp0)
"""
