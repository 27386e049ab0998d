import json
import math
import pathlib
import time

import pytest
from pyspark.sql import functions as F

from voxtally.functions import numbers, text
from voxtally.operators import grids, quality, robust
from voxtally.session import run_folder
from voxtally.sources import sidecars, sinks, tables
from voxtally.streaming import ingest

GOOD = {"dice": 0.9, "hd95_mm": 4.1, "abs_volumetric_error_mm3": 8170.0, "sensitivity": 0.87, "specificity": 1}


def document(**changes):
    doc = {"schema_version": "1.0", "subject_id": "0005", "comparison": "dl_vs_gt",
           "metrics": {c: dict(GOOD) for c in ("WT", "TC", "ET")}}
    for path, value in changes.items():
        *parents, last = path.split("__")
        node = doc
        for p in parents:
            node = node[p]
        if value is ...:
            del node[last]
        else:
            node[last] = value
    return json.dumps(doc)


def parsed(spark, values, **options):
    rows = [(f"{i:04d}", "dl_vs_gt", v) for i, v in enumerate(values, 1)]
    return sidecars.parse_metric_sidecars(
        spark.createDataFrame(rows, sidecars.DOCUMENT_SCHEMA), **options)


def test_reasons(spark):
    cases = [
        (document(), None), (None, "sidecar not found"), ("{bad", "could not parse JSON"),
        (document(schema_version=...), "missing 'schema_version'"),
        (document(schema_version="9"), "schema_version not accepted: 9"),
        (document(comparison="other"), "unexpected comparison: other"),
        (document(metrics=[1]), "'metrics' must be a mapping"),
        (document(metrics__TC=...), "missing compartment TC"),
        (document(metrics__TC=3), "compartment TC must be a mapping"),
        (document(metrics__ET__hd95_mm=...), "missing metric ET.hd95_mm"),
        (document(metrics__ET__hd95_mm=None, extra=1), None),
    ]
    rows = parsed(spark, [v for v, _ in cases]).select("value", "reason").collect()
    got = {r.value: r.reason for r in rows}
    assert got == dict(cases)


def test_ids_of_more_than_four_digits(spark):
    rows = sidecars.metrics_long(parsed(spark, [document(subject_id="sub-10003"), document(subject_id="0003")]))
    assert {r.subject_id for r in rows.collect()} == {"10003", "0003"}
    with pytest.raises(Exception, match="four-digit"):
        sidecars.metrics_long(parsed(spark, [document(subject_id="003")])).collect()


def test_strict_aborts(spark):
    with pytest.raises(Exception, match="missing compartment WT"):
        parsed(spark, [document(metrics__WT=...)], strict=True).select("reason").collect()


def test_value_classes(spark):
    values = [(0.5, "ok"), (3, "ok"), (None, "missing"), ("inf", "inf"), ("Inf", "missing"), ("-INF", "inf"),
              ("+inf", "inf"), ("nan", "missing"), ("text", "missing"), (True, "missing"), ([1], "missing")]
    docs = parsed(spark, [document(metrics__WT__dice=v, subject_id=f"{i:04d}") for i, (v, _) in enumerate(values)])
    rows = sidecars.metrics_long(docs).where("compartment = 'WT' AND metric = 'dice'").orderBy("subject_id").collect()
    assert [r.status for r in rows] == [s for _, s in values]
    assert rows[0].value == 0.5 and rows[2].value is None and rows[3].value == math.inf


def test_summary_counts_and_empty_cells(spark):
    docs = [document(metrics__WT__dice=v, subject_id=f"{i:04d}") for i, v in enumerate((0.1, 0.2, 0.4, None, "inf"))]
    long = sidecars.metrics_long(parsed(spark, docs))
    rows = robust.with_cell_text(robust.cell_summary(long, pairs=["dl_vs_gt", "other"])).collect()
    assert len(rows) == 30
    cell = next(r for r in rows if (r.pair_id, r.compartment, r.metric) == ("dl_vs_gt", "WT", "dice"))
    assert (cell.n_used, cell.n_missing, cell.n_inf, cell.cell) == (3, 1, 1, "0.200 [0.150, 0.300]")
    assert all(r.cell == "--" and r.n_used == 0 for r in rows if r.pair_id == "other")


def test_outlier_reasons(spark):
    doc = document(metrics__WT__dice=0.8125, metrics__TC__dice=None, metrics__ET__hd95_mm=20.06, metrics__WT__hd95_mm="inf")
    row = quality.flag_outliers(sidecars.quality_metrics(parsed(spark, [doc]))).first()
    assert row.flagged and row.reasons == (
        "WT_dice_lt_0.85(0.812); WT_hd95_inf; TC_dice_nan; ET_hd95_gt_20mm(20.1)")
    fine = quality.flag_outliers(sidecars.quality_metrics(parsed(spark, [document()]))).first()
    assert not fine.flagged and fine.reasons == ""


def run_document(**changes):
    return json.dumps({"schema_version": "1.0", "elapsed_s": 1.5, "backend": "b", "device": "mps", "version": "v1"} | changes)


def arrivals(spark, source, step):
    """Three files: good and broken documents of both kinds."""
    for k in range(3):
        n = 10 * step + k
        rows = [("metrics", f"{n:04d}", "dl_vs_gt", None, None, document(subject_id=f"{n:04d}")),
                ("metrics", f"{n:04d}", "dl_vs_gt", None, None, "{bad"),
                ("runs", f"{n:04d}", None, "seg", f"r{n}", run_document()),
                ("runs", f"{n:04d}", None, "seg", f"q{n}", run_document(elapsed_s=None))]
        spark.createDataFrame(rows, ingest.STREAM_SCHEMA).coalesce(1).write.mode("append").json(source)


def equals_batch_run(spark, base):
    documents = spark.read.schema(ingest.STREAM_SCHEMA).json(f"{base}/in").withColumn("mtime", F.lit(0.0))
    for name, rows in ingest.TABLES.items():
        got, want = (d.drop("mtime") for d in (ingest.read_ingested(spark, f"{base}/out", name), rows(documents)))
        assert want.count() == {"metrics": 90, "metric_problems": 6, "runs": 6, "run_problems": 6}[name]
        assert sorted(got.columns) == sorted(want.columns)
        assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_ingest_twice_equals_batch(spark):
    base = run_folder(spark, "test-ingest")
    for step in range(2):
        arrivals(spark, f"{base}/in", step)
        for _ in range(2):  # the second run finds nothing new
            ingest.ingest_sidecars(spark, f"{base}/in", f"{base}/out", f"{base}/state", files_per_batch=2)
    equals_batch_run(spark, base)


@pytest.mark.parametrize("fails_at", [1, 3, 6])
def test_ingest_stopped_between_two_tables(spark, monkeypatch, fails_at):
    base, write, calls = run_folder(spark, "test-ingest"), ingest.write_part, []
    for step in range(2):
        arrivals(spark, f"{base}/in", step)

    def stops(rows, table, batch):
        calls.append(table)
        if len(calls) == fails_at + 1:
            raise RuntimeError("stopped here")
        write(rows, table, batch)

    monkeypatch.setattr(ingest, "write_part", stops)
    with pytest.raises(Exception, match="stopped here"):
        ingest.ingest_sidecars(spark, f"{base}/in", f"{base}/out", f"{base}/state", files_per_batch=4)
    monkeypatch.setattr(ingest, "write_part", write)
    ingest.ingest_sidecars(spark, f"{base}/in", f"{base}/out", f"{base}/state", files_per_batch=1)
    equals_batch_run(spark, base)


def test_json_numbers_and_versions(spark):
    row = spark.range(1).select(
        numbers.json_number(F.lit(2.5)).alias("a"), numbers.json_number(F.lit(float("inf"))).alias("b"),
        numbers.json_number(F.lit(float("nan"))).alias("c"),
        numbers.json_number(F.lit(float("inf")), infinity=None).alias("d"),
        text.version_from_banner(F.lit("engine-macOS-arm64-8.2.0-2026-d9")).alias("e"),
        text.fixed(F.lit(float("-inf")), 3).alias("f"),
    ).first()
    assert tuple(row) == ("2.5", '"inf"', "null", "null", "8.2.0", "-inf")


def folders(path):
    return [p for p in pathlib.Path(path).rglob("*") if p.is_dir()]


def test_existing_outputs_are_left_alone(spark, monkeypatch):
    path = run_folder(spark, "test-resume")
    rows = spark.range(10_000).selectExpr("lpad(id, 5, '0') AS subject_id", "id AS v", "explode(array(1, 2)) AS part")
    half = rows.where("v % 2 = 0")
    assert sinks.write_missing(half, path, ["subject_id"], buckets=8) == 5000
    assert sinks.write_missing(half, path, ["subject_id"], buckets=8) == 0
    assert len(folders(path)) <= 8 + 6

    # A run that ends after its rows and before its list of keys leaves rows that do not count.
    append = sinks.bucketed(rows.where("v % 2 = 1 AND v < 100").selectExpr("*", "'broken' AS run"), ["subject_id"], 8)
    append.write.mode("append").partitionBy("bucket").parquet(f"{path}/rows")
    assert sinks.read_written(spark, path, ["subject_id"]).count() == 10_000
    assert sinks.write_missing(rows.withColumn("v", F.col("v") + 10_000), path, ["subject_id"], buckets=8) == 5000
    assert sinks.write_missing(rows, path, ["subject_id"], buckets=8) == 0
    got = sinks.read_written(spark, path, ["subject_id"])
    assert set(got.columns) == {"subject_id", "v", "part"}
    assert got.count() == 20_000 == got.distinct().count()
    assert got.where("v >= 10000 AND cast(subject_id AS INT) % 2 = 1").count() == 10_000
    assert len(folders(path)) <= 8 + 10


def test_run_files_by_time_of_writing(spark):
    path = run_folder(spark, "test-runs")
    for name, text in [("0009", run_document(elapsed_s=9.0)), ("0001", run_document(elapsed_s=1.0)), ("0002", "{bad"),
                       ("0003", run_document(elapsed_s="fast")), ("0004", run_document(schema_version="8"))]:
        spark.createDataFrame([(text, "seg", f"sub-{name}")], "value STRING, stage STRING, subject_id STRING") \
            .write.mode("append").partitionBy("stage", "subject_id").text(path)
        time.sleep(0.02)
    expected = spark.createDataFrame(
        [("seg", f"{i:04d}") for i in (1, 2, 3, 4, 5, 9)], "stage STRING, subject_id STRING")
    good, problems = sidecars.run_records(sidecars.read_run_files(spark, path), expected)
    phases = grids.cold_and_warm(good.withColumn("run_id", F.col("subject_id"))).collect()
    assert {(r.subject_id, r.elapsed_s, r.phase) for r in phases} == {("0009", 9.0, "cold"), ("0001", 1.0, "warm")}
    assert {tuple(r) for r in problems.collect()} == {
        ("0002", "seg", "could not parse JSON"), ("0003", "seg", "missing finite 'elapsed_s'"),
        ("0004", "seg", "schema_version not accepted"), ("0005", "seg", "sidecar not found")}


def test_many_runs_in_a_file(spark):
    path = run_folder(spark, "test-run-lines")
    for first, end in ((990, 1000), (0, 990)):
        spark.range(first, end).selectExpr(
            "lpad(id, 4, '0') AS subject_id", "'seg' AS stage",
            """if(id % 5 = 0, '{bad', '{"schema_version":"1.0","elapsed_s":2.5}') AS value""",
        ).coalesce(2).write.mode("append").json(path)
        time.sleep(0.05)
    assert len([p for p in pathlib.Path(path).rglob("part-*")]) == 4
    good, problems = sidecars.run_records(sidecars.read_run_lines(spark, path))
    assert (good.count(), problems.count()) == (800, 200)
    phases = grids.cold_and_warm(good.withColumn("run_id", F.col("subject_id")))
    assert [r.subject_id for r in phases.where("phase = 'cold'").collect()] == ["0991"]


def test_documents_in_folders_and_in_lines_read_alike(spark):
    docs = spark.createDataFrame([("0001", "dl_vs_gt", document()), ("0002", "dl_vs_gt", "{bad")], sidecars.DOCUMENT_SCHEMA)
    path = run_folder(spark, "test-documents")
    docs.write.partitionBy("pair_id", "subject_id").text(f"{path}/folders")
    docs.write.json(f"{path}/lines")
    read = [sidecars.read_documents(spark, f"{path}/folders"), sidecars.read_document_lines(spark, f"{path}/lines")]
    rows = [sorted(map(tuple, sidecars.parse_metric_sidecars(d).select("subject_id", "pair_id", "reason").collect()), key=str)
            for d in read]
    assert rows[0] == rows[1] and len(rows[0]) == 2


def test_packed_files_are_listed_without_their_content(spark):
    path = run_folder(spark, "test-packs")
    files = spark.range(3000).selectExpr("concat('a/', id) AS path", "cast(repeat('x', int(id % 7)) AS BINARY) AS content")
    sinks.pack_files(files.coalesce(2), path)
    listed = tables.read_packed_inventory(spark, path)
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()
    assert len(list(pathlib.Path(path).glob("part-*"))) == 2
    assert listed.count() == 3000 and listed.where("size_bytes = cast(substr(path, 3) AS INT) % 7").count() == 3000


def test_inventory_lists_files_without_reading_them(spark):
    path = run_folder(spark, "test-files")
    root = pathlib.Path(path)
    for name, n in (("a/T1.nii.gz", 5), ("a/b/odd name.nii.gz", 2), ("empty.nii.gz", 0), ("note.txt", 3)):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * n)
    files = tables.read_file_inventory(spark, path, "*.nii.gz")
    headers = spark.createDataFrame(
        [("a/T1.nii.gz", [4, 4, 4], [1.0, 1.0, 2.0], None, "uint8"), ("gone.nii.gz", [1], [1.0], "RAS", "uint8")],
        "path STRING, shape ARRAY<INT>, voxel_size_mm ARRAY<DOUBLE>, orientation STRING, dtype STRING")
    listed = tables.volume_inventory(files, headers)
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "length" in plan
    assert {tuple(r) for r in listed.selectExpr("path", "size_bytes", "shape[0]", "orientation", "dtype").collect()} == {
        ("a/T1.nii.gz", 5, 4, "?", "uint8"), ("a/b/odd name.nii.gz", 2, None, None, None)}


def test_rating_columns_are_found_by_their_titles(spark):
    titles = ["Patient", "Date", "Rating (according to RANO, PD: progress)", "Other", "RATING Rationale (a, b)"]
    rows = spark.createDataFrame([("p1", "tp-1", "PD", "x", "growth, new")], ", ".join(f"`{t}` STRING" for t in titles))
    path = run_folder(spark, "test-ratings")
    rows.write.csv(path, header=True, escape='"')
    assert tables.read_ratings(spark, path).first().asDict() == {
        "patient_id": "p1", "timepoint": "tp-1", "rano": "PD", "rano_rationale": "growth, new", "line": None}
    bare = spark.createDataFrame([("PD", "SD")], "rating STRING, `rating of` STRING")
    assert tables.pick_columns(bare, {"rano": "rating( |$)"}).first().rano == "SD"


def test_empty_color_table_is_an_error(spark):
    lines = spark.createDataFrame([("# only a comment",), ("1 x 2",)], "value STRING")
    with pytest.raises(ValueError):
        tables.require_rows(tables.parse_color_table(lines), "color table")
