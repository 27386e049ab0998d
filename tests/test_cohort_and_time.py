import pytest

from voxtally.operators import cohort, longitudinal

ROWS = [  # timepoint, day, code, WT, TC, ET, NCR, ED
    ("week-000-1", 0, "Pre-Op", 70.0, 17.0, 12.0, 5.0, 53.0),
    ("week-000-2", 3, "Post-Op", 56.0, 22.0, 1.8, 20.0, 34.0),
    ("week-013", 91, "SD", 16.0, 9.0, 0.4, 8.6, 7.0),
    ("week-023", 161, "CR", 16.5, 8.0, 0.5, 7.5, 8.0),
    ("week-045", 315, "PD", 14.0, 7.5, 1.8, 5.7, 6.2),
    ("week-049", 343, "PD", 50.0, 17.5, 11.4, 6.1, 32.5),
]


@pytest.fixture(scope="module")
def curve(spark):
    return spark.createDataFrame(
        [("p", *r) for r in ROWS],
        "patient_id STRING, timepoint STRING, days_since_baseline INT, rano STRING, vol_WT_ml DOUBLE, "
        "vol_TC_ml DOUBLE, vol_ET_ml DOUBLE, vol_NCR_ml DOUBLE, vol_ED_ml DOUBLE")


def test_landmarks(curve):
    peaks = {r.compartment: (r.timepoint, r.value_ml) for r in longitudinal.peaks(curve).collect()}
    assert peaks == {
        "WT": ("week-000-1", 70.0), "TC": ("week-000-2", 22.0), "ET": ("week-000-1", 12.0),
        "ED": ("week-000-1", 53.0), "NCR": ("week-000-2", 20.0)}
    change = longitudinal.surgery_change(curve).first()
    assert change.postop_ET_drop_ml == pytest.approx(10.2)
    assert change.postop_WT_change_ml == pytest.approx(-14.0)
    row = longitudinal.recurrence(curve).first()
    assert (row.recurrence_ET_trough_timepoint, row.recurrence_ET_trough_ml) == ("week-013", 0.4)
    assert (row.recurrence_ET_last_PD_timepoint, row.recurrence_ET_at_last_PD_ml) == ("week-049", 11.4)
    assert row.recurrence_ET_rise_ml == pytest.approx(11.0)


def test_without_surgery_or_progression(curve):
    row = longitudinal.surgery_change(curve.where("rano <> 'Post-Op'")).first()
    assert row.postop_ET_drop_ml is None
    assert longitudinal.recurrence(curve.where("rano <> 'PD'")).count() == 0
    early = longitudinal.recurrence(curve.where("rano <> 'Post-Op'")).first()
    assert early.recurrence_ET_trough_timepoint == "week-013"


def test_sample_is_reproducible_and_takes_short_cells_whole(spark):
    rows = [(f"{i:04d}", "M" if i % 2 else "F", ("short", "mid", "long")[i % 3]) for i in range(120)]
    rows = [r for r in rows if r[1:] != ("F", "long")] + [("9001", "F", "long"), ("9002", "F", "long")]
    binned = spark.createDataFrame(rows, "subject_id STRING, Sex STRING, OS_tertile STRING")
    draw = lambda seed: [r.subject_id for r in cohort.stratified_sample(binned, seed).collect()]
    first = draw(1)
    assert first == draw(1) == sorted(first) and first != draw(2)
    assert len(set(first)) == len(first) == 10 * 3 + 7 + 7 + 2
    short = {(r.Sex, r.OS_tertile): r.short for r in cohort.allocation_cells(binned).collect()}
    assert [k for k, v in short.items() if v] == [("F", "long")]


def test_large_cells_are_cut_before_the_shuffle(spark):
    binned = spark.range(1000).selectExpr(
        "cast(id AS STRING) AS subject_id", "if(id % 9 = 0, 'F', 'M') AS Sex", "if(id % 7 = 0, 'long', 'mid') AS OS_tertile")
    plan = cohort.stratified_sample(binned, 1)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_missing_member_and_wrong_length_abort(spark):
    exams = spark.createDataFrame([("0001", "x")], "subject_id STRING, ID STRING")
    ids = spark.createDataFrame([("0001",), ("0002",)], "subject_id STRING")
    with pytest.raises(Exception, match="absent from the metadata"):
        cohort.join_cohort(ids, exams).collect()
    with pytest.raises(Exception, match="declares n=3"):
        cohort.join_cohort(ids.where("subject_id = '0001'"), exams, declared_n=3).collect()
    assert [r.subject_id for r in cohort.missing_ids(ids, exams).collect()] == ["0002"]


def test_only_rows_of_top_regions_are_ordered(spark):
    rows = [("s", t, label, f"r{label % 4}", "WT", float(label), 1000.0 * label) for t in (1, 2) for label in range(1, 9)]
    table = spark.createDataFrame(
        rows, "subject_id STRING, timepoint INT, label INT, name STRING, compartment STRING, pct_of_parcel DOUBLE, "
        "overlap_volume_mm3 DOUBLE")
    frame = longitudinal.region_by_timepoint(table, (1, 2, 3), 2)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "min_by" in plan and "LeftSemi" in plan
    assert sorted(map(tuple, frame.drop("max_ml").collect())) == [
        ("s", "WT", "r0", 1, 4.0, 4.0, 0.0), ("s", "WT", "r3", 2, 3.0, 3.0, 0.0)]
