import itertools
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voxtally.constants import COMPARTMENTS
from voxtally.operators import agreement, intensity, regions, rollups


@pytest.fixture(scope="module")
def cubes(spark):
    """Two halves of a 10^3 grid; cubes of 125 voxels of ET, NCR and ED."""
    rows = []
    for x, y, z in itertools.product(range(10), repeat=3):
        label = 0
        if z < 5:
            label = 4 if x < 5 and y < 5 else 1 if x >= 5 and y < 5 else 2 if x >= 5 else 0
        rows.append(("0001", x, y, z, 1 if x < 5 else 2, label))
    return spark.createDataFrame(
        rows, "subject_id STRING, x INT, y INT, z INT, region INT, label INT").cache()


@pytest.fixture(scope="module")
def lut(spark):
    return spark.createDataFrame([(1, "left"), (2, "right"), (9, "absent")], "label INT, name STRING")


def test_two_regions_three_cubes(cubes, lut):
    got = {(r.label, r.compartment): r for r in regions.region_matrix(cubes, lut).collect()}
    assert len(got) == 6
    assert {c: got[1, c].compartment_voxels for c in COMPARTMENTS} == {"WT": 375, "TC": 250, "ET": 125}
    assert [got[1, c].overlap_voxels for c in COMPARTMENTS] == [125, 125, 125]
    assert [got[2, c].overlap_voxels for c in COMPARTMENTS] == [250, 125, 0]
    assert got[2, "ET"].pct_of_compartment == 0.0
    assert got[2, "WT"].pct_of_parcel == pytest.approx(50.0)


def test_empty_compartment_has_null_share(cubes, lut):
    none = cubes.withColumn("label", F.when(F.col("label") == 4, 0).otherwise(F.col("label")))
    rows = regions.region_matrix(none, lut).where("compartment = 'ET'").collect()
    assert len(rows) == 2 and all(r.pct_of_compartment is None for r in rows)


def test_regions_outside_the_lookup_count_in_the_total(cubes, spark):
    only_left = spark.createDataFrame([(1, "left")], "label INT, name STRING")
    row = regions.region_matrix(cubes, only_left).where("compartment = 'WT'").first()
    assert (row.overlap_voxels, row.compartment_voxels) == (125, 375)


def test_unknown_compartment_is_refused(cubes, lut):
    with pytest.raises(ValueError):
        regions.region_matrix(cubes, lut, compartments=("WT", "XX"))


def test_hard_probabilities_equal_the_hard_matrix(cubes, lut):
    hard = cubes.withColumn("p", F.array(*[
        F.when(F.col("label").isin(*codes), 1.0).otherwise(0.0) for codes in ((1, 4), (1, 2, 4), (4,))]))
    prob = {(r.label, r.compartment): r for r in regions.probabilistic_region_matrix(hard, lut).collect()}
    for row in regions.region_matrix(cubes, lut).collect():
        cell = prob[row.label, row.compartment]
        assert cell.overlap_voxels_mean == row.overlap_voxels and cell.overlap_voxels_std == 0.0


def test_uniform_probability_and_channel_order_from_a_column(cubes, lut):
    soft = cubes.withColumns({
        "p": F.array(F.lit(0.1), F.lit(0.5), F.lit(0.3)),
        "order": F.array(F.lit("ET"), F.lit("TC"), F.lit("WT")),
    })
    rows = regions.probabilistic_region_matrix(soft, lut, channels=F.col("order")).where("label = 1").collect()
    got = {r.compartment: r for r in rows}
    for c, p in (("ET", 0.1), ("TC", 0.5), ("WT", 0.3)):
        assert got[c].overlap_voxels_mean == pytest.approx(500 * p)
        assert got[c].overlap_voxels_std == pytest.approx(math.sqrt(500 * p * (1 - p)))


def test_probability_out_of_range_aborts(cubes, lut):
    bad = cubes.withColumn("p", F.array(F.lit(0.1), F.lit(1.5), F.lit(0.3)))
    with pytest.raises(PySparkException):
        regions.probabilistic_region_matrix(bad, lut).collect()


def test_parcel_burden(spark):
    cells = spark.createDataFrame(
        [("0001", r, t) for r, t in zip((1, 1, 2, 2, 2, 3), (1, 0, 1, 0, 0, 0))],
        "subject_id STRING, region INT, t INT")
    lut = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "label INT, name STRING")
    got = {r.label: r.pct_burden for r in regions.parcel_burden(cells, lut, F.col("t") > 0).collect()}
    assert got == pytest.approx({1: 50.0, 2: 100 / 3, 3: 0.0})


MINI_LUT = {
    1028: ("ctx-lh-superiorfrontal", "frontal"), 1010: ("ctx-lh-isthmuscingulate", "cingulate"),
    1035: ("ctx-lh-insula", "insula"), 1029: ("ctx-lh-superiorparietal", "parietal"),
    1030: ("ctx-lh-superiortemporal", "temporal"), 1011: ("ctx-lh-lateraloccipital", "occipital"),
    10: ("Left-Thalamus", "subcortical-deep"), 17: ("Left-Hippocampus", "subcortical-limbic"),
    8: ("Left-Cerebellum-Cortex", "cerebellum"), 16: ("Brain-Stem", "brainstem"),
    4: ("Left-Lateral-Ventricle", "other"),
}


def table_of(spark, overlaps, voxel=2.0):
    rows = [("0001", label, MINI_LUT[label][0], c, 1000, overlaps.get((label, c), 0),
             overlaps.get((label, c), 0) * voxel) for label in MINI_LUT for c in COMPARTMENTS]
    return spark.createDataFrame(
        rows, "subject_id STRING, label INT, name STRING, compartment STRING, "
        "parcel_voxels BIGINT, overlap_voxels BIGINT, overlap_volume_mm3 DOUBLE")


def test_each_label_reaches_its_lobe_and_shares_add_up(spark):
    table = table_of(spark, {(label, "WT"): 10 for label in MINI_LUT})
    rows = rollups.lobe_cells(table).collect()
    assert len(rows) == 33
    wt = {r.lobe: r for r in rows if r.compartment == "WT"}
    assert all(r.overlap_volume_mm3 == 20.0 and r.lobe_volume_mm3 == 2000.0 for r in wt.values())
    assert sum(r.share_of_compartment_pct for r in wt.values()) == pytest.approx(100.0)
    assert all(r.share_of_compartment_pct is None for r in rows if r.compartment == "ET")


def test_functional_groups_overlap_but_keep_the_original_total(spark):
    table = table_of(spark, {(1030, "WT"): 10, (10, "WT"): 30})
    got = {r.group_id: r for r in rollups.group_cells(table).where("compartment = 'WT'").collect()}
    assert got["functional:left_language_adjacent"].share_of_compartment_pct == pytest.approx(25.0)
    assert got["functional:deep_midline_commissural"].share_of_compartment_pct == pytest.approx(75.0)
    assert got["functional:motor_adjacent"].overlap_volume_mm3 == 0.0


def test_prevalence_divides_by_the_cohort(spark):
    table = table_of(spark, {(10, "WT"): 5})
    cohort = spark.createDataFrame([("0001",), ("0002",), ("0003",), ("0004",)], "subject_id STRING")
    row = rollups.cohort_cells(rollups.lobe_cells(table), cohort).where(
        "lobe = 'subcortical-deep' AND compartment = 'WT'").first()
    assert (row.n_total, row.n_with_table, row.n_with_overlap, row.prevalence) == (4, 1, 1, 0.25)


def test_without_any_overlap_the_voxel_volume_is_one(spark):
    assert rollups.inferred_voxel_volume(table_of(spark, {})).first().voxel_volume_mm3 == 1.0


def test_voxel_size_of_each_volume(spark):
    cells = spark.createDataFrame(
        [("a", 1, 4, 0.5), ("a", 1, 0, 0.5), ("b", 1, 4, 2.0)],
        "subject_id STRING, region INT, label INT, mm3 DOUBLE")
    lut = spark.createDataFrame([(1, "one")], "label INT, name STRING")
    by_name = regions.region_matrix(cells, lut, voxel_mm3="mm3")
    by_column = regions.region_matrix(cells, lut, voxel_mm3=F.col("mm3") * 1.0)
    for matrix in (by_name, by_column):
        got = {r.subject_id: r.overlap_volume_mm3 for r in matrix.where("compartment = 'ET'").collect()}
        assert got == {"a": 0.5, "b": 2.0}


def test_comparators_of_another_shape_are_marked_and_never_scored(spark):
    keys = "subject_id STRING, source STRING, shape ARRAY<INT>, voxel_mm3 DOUBLE"
    grids = spark.createDataFrame(
        [(s, "dl", [4, 4, 4], 2.0) for s in "abd"] + [
            ("a", "hdglio", [4, 4, 4], 9.0), ("a", "deepbratumia", [4, 4, 5], 9.0), ("b", "hdglio", [4, 4, 4], 9.0),
            ("c", "hdglio", [4, 4, 4], 9.0)], keys)
    voxel = "subject_id STRING, x INT, y INT, z INT, label INT"
    ours = spark.createDataFrame([("a", 0, 0, 0, 4), ("a", 1, 0, 0, 2), ("b", 0, 0, 0, 1)], voxel)
    theirs = spark.createDataFrame(
        [("a", 0, 0, 0, 2, "hdglio"), ("a", 2, 0, 0, 1, "hdglio"), ("a", 0, 0, 0, 1, "deepbratumia"),
         ("c", 0, 0, 0, 1, "hdglio")], voxel + ", kind STRING")
    out = agreement.checked_comparator_agreement(ours, theirs, grids, keys=["subject_id"])
    got = {(r.subject_id, r.kind, r.compartment): r for r in out.collect()}
    assert set(got) == {("a", "hdglio", "WT"), ("a", "hdglio", "ET"), ("a", "deepbratumia", None),
                        ("b", "hdglio", "WT"), ("b", "hdglio", "ET")}
    odd = got["a", "deepbratumia", None]
    assert (odd.status, odd.ref_shape, odd.comparator_shape, odd.dice) == ("shape mismatch", [4, 4, 4], [4, 4, 5], None)
    whole = got["a", "hdglio", "WT"]
    assert (whole.status, whole.dice, whole.jaccard, whole.vol_pred_ml) == ("ok", 0.5, pytest.approx(1 / 3), 0.004)
    assert got["b", "hdglio", "WT"].dice == 0.0 and got["b", "hdglio", "ET"].dice is None


def test_coverage_of_missing_and_empty_maps(spark):
    keys = "patient_id INT, timepoint INT, comparator STRING"
    expected = spark.createDataFrame(
        [(1, 0, "h", 0.5, 0.25), (1, 1, "h", 0.5, None), (1, 2, "h", 0.5, 0.25), (2, 0, "h", 0.5, 0.25)],
        keys + ", src_ml DOUBLE, dst_ml DOUBLE")
    voxel = keys + ", x INT, y INT, z INT, label INT"
    before = spark.createDataFrame([(1, 0, "h", 0, 0, 0, 1), (1, 0, "h", 1, 0, 0, 2), (1, 1, "h", 0, 0, 0, 1), (2, 0, "h", 0, 0, 0, 1)], voxel)
    after = spark.createDataFrame(
        [(1, 0, "h", 0, 0, 0, 1), (1, 0, "h", 5, 0, 0, 1), (1, 0, "h", 1, 0, 0, 0), (1, 1, "h", 0, 0, 0, 1), (2, 0, "h", 0, 0, 0, 1)], voxel)
    reference = spark.createDataFrame(
        [(1, 0, 0, 0, 100.0), (1, 5, 0, 0, 5.0)], "patient_id INT, x INT, y INT, z INT, v DOUBLE")
    out = intensity.registration_coverage(expected, before, after, reference)
    got = {(r.patient_id, r.timepoint): r for r in out.collect()}
    assert len(got) == out.count() == 4
    r = got[1, 0]
    assert (r.status, r.labels_preserved, r.src_labels, r.dst_labels) == ("ok", False, "1,2", "1")
    assert (r.src_volume_ml, r.dst_volume_ml, r.label, r.voxels, r.volume_ml, r.fraction_inside_brain) == (1.0, 0.5, 1, 2, 0.5, 0.5)
    assert got[1, 1].status == "missing" and got[1, 1].label is None and got[1, 1].src_volume_ml is None
    assert (got[1, 2].status, got[1, 2].dst_labels, got[1, 2].label, got[1, 2].dst_volume_ml) == ("ok", "", None, 0.0)
    assert (got[2, 0].voxels, got[2, 0].fraction_inside_brain) == (1, None)
