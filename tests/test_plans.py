"""Plans that must hold at scale: pruned scans, map-side combining, no gathering."""

import re

from pyspark.sql import functions as F

from voxtally.operators import agreement, geometry, intensity, regions
from voxtally.plans import bindings as b
from voxtally.session import run_folder
from voxtally.sources import tables
from voxtally.sources.stored_voxels import open_voxels, store_voxels


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_region_matrix_reads_few_columns_and_combines_before_the_shuffle(spark, folder):
    plan = physical(regions.region_matrix(b.cells(spark, folder), b.lut(spark), label="pred"))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"}
    assert "partial_count" in plan and "CartesianProduct" not in plan and "Python" not in plan


def test_source_filter_prunes_partitions(spark):
    path = run_folder(spark, "test-voxels")
    spark.range(10).selectExpr("id", "if(id % 2 = 0, 'dl', 'gt') AS source").write.partitionBy("source").parquet(path)
    plan = physical(tables.read_voxels(spark, path, "gt"))
    assert re.search(r"PartitionFilters: \[[^\]]*source[^\]]*gt", plan)


def test_statistics_are_broadcast_only_below_the_planners_bound(spark):
    voxels = spark.createDataFrame(
        [("s", "T1", i, 0, 0, float(i % 5)) for i in range(20)],
        "subject_id STRING, channel STRING, x INT, y INT, z INT, v DOUBLE")
    assert "BroadcastHashJoin" in physical(intensity.zscore_brain(voxels))
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        assert "SortMergeJoin" in physical(intensity.zscore_brain(voxels))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)


def test_expanded_voxels_are_never_broadcast(spark):
    few = spark.range(40).selectExpr("lpad(id, 4, '0') AS subject_id", "'T1' AS channel", "explode(sequence(0, 99)) AS x",
                                     "0 AS y", "0 AS z", "double(id) AS v", "1 AS whole", "2 AS label")
    inner = few.select("subject_id", "x", "y", "z", F.lit(2).alias("inner"))
    whole = few.select("subject_id", "x", "y", "z", F.lit(18).alias("whole"))
    grids = spark.createDataFrame([("0001", "dl", [1], 1.0), ("0001", "hdglio", [1], 1.0)],
                                  "subject_id STRING, source STRING, shape ARRAY<INT>, voxel_mm3 DOUBLE")
    visits = few.withColumnRenamed("subject_id", "patient_id").withColumn("timepoint", F.lit(0))
    plans = {
        "p4": geometry.two_stage_map(whole, inner), "a30": intensity.reference_correlation(visits, F.lit(True)),
        "p22": intensity.roi_masked(few, inner), "a32": intensity.brain_coverage(few, few),
        "a29": agreement.checked_comparator_agreement(few, few.withColumn("kind", F.lit("hdglio")), grids, keys=["subject_id"]),
    }
    for name, frame in plans.items():
        for sent in re.findall(r"BroadcastExchange.*\n(?:.*\n){0,6}", physical(frame)):
            assert name == "a29" and "Generate" not in sent.split("Exchange hashpartitioning")[0], (name, sent)
    # Of a statistics join the voxels can only be the side that stays.
    for frame in (intensity.zscore_brain(few), intensity.percentile_rescaled(few)):
        assert re.findall(r"Join.*(LeftOuter|Inner), Build(\w+)", physical(frame)) == [("LeftOuter", "Right")]


def test_tasks_that_expand_grow_with_the_parents(spark):
    many = spark.range(40 * b.PARENTS_PER_TASK)
    assert b.spread(many).rdd.getNumPartitions() == 40


def test_stored_voxels_join_without_moving_rows(spark):
    path = run_folder(spark, "test-buckets")
    rows = [(f"{s:04d}", x, y, 0, 1 + x % 2) for s in range(3) for x in range(9) for y in range(9)]
    voxels = spark.createDataFrame(rows, "subject_id STRING, x INT, y INT, z INT, label INT")
    sides = {"a": voxels.where("x < 6"), "b": voxels.where("x > 2")}
    stored = [store_voxels(rows, f"{path}/{name}", buckets=5) for name, rows in sides.items()]
    again = [open_voxels(spark.newSession(), f"{path}/{name}") for name in sides]
    loose = physical(agreement.aligned_pair(*sides.values()))
    assert "Exchange" in loose
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for pair in (stored, again):
        pair[0].sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = agreement.aligned_pair(*pair)
        assert "SortMergeJoin" in physical(joined) and "Exchange" not in physical(joined)
        counts = agreement.confusion_counts(joined)
        assert physical(counts).count("Exchange") == 1  # partial counts only
        want = agreement.confusion_counts(agreement.aligned_pair(*sides.values()))
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)


def test_flat_and_empty_volumes(spark):
    rows = [("flat", i, 5.0 if i < 4 else 0.0) for i in range(8)] + [("empty", i, 0.0) for i in range(8)]
    voxels = spark.createDataFrame(
        [(s, "T1", i, 0, 0, v) for s, i, v in rows],
        "subject_id STRING, channel STRING, x INT, y INT, z INT, v DOUBLE")
    assert {r.z_score for r in intensity.zscore_brain(voxels).collect()} == {0.0}
    assert {r.scaled for r in intensity.percentile_rescaled(voxels.where("subject_id = 'empty'")).collect()} == {0.0}
    shapes = spark.createDataFrame([("flat", [8, 4, 4]), ("empty", [8, 4, 4])], "subject_id STRING, shape ARRAY<INT>")
    boxes = {r.subject_id: tuple(r)[2:] for r in intensity.bounding_boxes(voxels, shapes, percentile=5.0, pad=1).collect()}
    assert boxes == {"flat": (0, 5, 0, 2), "empty": (0, 8, 0, 4)}


def test_masked_score_divides_by_the_padded_deviation(spark):
    voxels = spark.createDataFrame(
        [("s", "T1", i, 0, 0, float(v)) for i, v in enumerate((1, 3, 100))],
        "subject_id STRING, channel STRING, x INT, y INT, z INT, v DOUBLE")
    got = [r.z_score for r in intensity.zscore_in_mask(voxels, F.col("x") < 2).orderBy("x").collect()]
    assert [round(v, 5) for v in got] == [-1.0, 1.0, 98.0]
