import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from voxtally.operators import geometry


def block(lo, hi):
    return set(itertools.product(*[range(a, b) for a, b in zip(lo, hi)]))


def volume(spark, pairs):
    rows = []
    for subject, (pred, ref) in pairs.items():
        rows += [(subject, *v, 4 if v in pred else 0, 4 if v in ref else 0) for v in pred | ref]
    return spark.createDataFrame(rows, "subject_id STRING, x INT, y INT, z INT, pred INT, ref INT")


def grid(spark, subjects, spacing=(1.0, 1.0, 1.0), shape=(60, 40, 40)):
    return spark.createDataFrame(
        [(s, list(shape), list(spacing)) for s in subjects],
        "subject_id STRING, shape ARRAY<INT>, voxel_size_mm ARRAY<DOUBLE>")


def brute_surface(mask):
    steps = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    return {v for v in mask if any(tuple(a + b for a, b in zip(v, s)) not in mask for s in steps)}


def brute_distances(pred, ref, spacing):
    out = {}
    for side, a, b in (("pred", pred, ref), ("ref", ref, pred)):
        for q in a:
            out[side, q] = min(
                math.sqrt(sum(((i - j) * s) ** 2 for i, j, s in zip(q, t, spacing))) for t in b)
    return out


def hd(spark, pred, ref, percentile=95.0, spacing=(1.0, 1.0, 1.0)):
    cells = volume(spark, {"0001": (pred, ref)})
    rows = geometry.hausdorff(cells, grid(spark, ["0001"], spacing), percentile=percentile).collect()
    return {r.compartment: r.hausdorff_mm for r in rows}["ET"]


A, B = block((5, 5, 5), (15, 15, 15)), block((8, 5, 5), (18, 15, 15))


def test_identical_and_shifted_blocks(spark):
    assert hd(spark, A, A) == 0.0
    assert hd(spark, A, B) == pytest.approx(3.0, abs=1e-9)
    assert hd(spark, A, B, spacing=(0.5, 1.0, 1.0)) == pytest.approx(1.5, abs=1e-9)


def test_empty_masks(spark):
    assert hd(spark, set(), A) == math.inf
    assert hd(spark, A, set()) == math.inf
    assert hd(spark, set(), set()) is None


def test_far_voxel(spark):
    assert hd(spark, A, A | {(55, 14, 14)}, percentile=100.0) == pytest.approx(41.0, abs=1e-9)
    assert hd(spark, A, A | {(55, 28, 28)}) < 5.0


def test_surface_of_touching_and_edge_blocks(spark):
    pred, ref = block((0, 0, 0), (6, 6, 6)), block((3, 2, 1), (9, 8, 7)) - {(5, 5, 5)}
    rows = geometry.paired_surfaces(volume(spark, {"0001": (pred, ref)})).where(
        "compartment = 'ET'").collect()
    got = {s: {(r.x, r.y, r.z) for r in rows if r.side == s} for s in ("pred", "ref")}
    assert got == {"pred": brute_surface(pred), "ref": brute_surface(ref)}


@pytest.mark.parametrize("levels, direct", [
    ((5, 2, 0), 0), ((5, 3, 1, 0), 0), ((6, 0), 0), ((0,), 0), (geometry.BOX_LEVELS, 0), (geometry.BOX_LEVELS, 1 << 16)])
@pytest.mark.parametrize("spacing", [(1.0, 1.0, 1.0), (0.7, 1.3, 2.9)])
def test_nearest_distance_equals_brute_force(spark, monkeypatch, spacing, levels, direct):
    monkeypatch.setattr(geometry, "DIRECT_PAIRS", direct)
    rng = random.Random(7)
    scattered = {tuple(rng.randrange(200) for _ in range(3)) for _ in range(60)}
    far = {tuple(rng.randrange(150, 250) for _ in range(3)) for _ in range(40)}
    rows = [("0001", "WT", side, *v) for side, s in (("pred", scattered), ("ref", far)) for v in s]
    surface = spark.createDataFrame(
        rows, "subject_id STRING, compartment STRING, side STRING, x INT, y INT, z INT")
    got = geometry.nearest_surface(surface, grid(spark, ["0001"], spacing), levels=levels).collect()
    want = brute_distances(scattered, far, spacing)
    assert len(got) == len(want)
    for r in got:
        assert r.distance_mm == pytest.approx(want[r.side, (r.x, r.y, r.z)], abs=1e-9)


def test_volumes_of_any_extent_in_one_table_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(geometry, "DIRECT_PAIRS", 4)
    rng, rows, want = random.Random(3), [], {}
    for subject, extent in (("0001", 3), ("0002", 9), ("0003", 40), ("0004", 600)):
        at = rng.randrange(1000) - 500
        sides = {s: {tuple(at + rng.randrange(extent) for _ in range(3)) for _ in range(40)} for s in ("pred", "ref")}
        want |= {(subject, *k): v for k, v in brute_distances(sides["pred"], sides["ref"], (1.0, 1.0, 2.0)).items()}
        rows += [(subject, "TC", side, *v) for side, s in sides.items() for v in s]
    rows += [("0005", "TC", "pred", 1, 2, 3)]
    surface = spark.createDataFrame(
        rows, "subject_id STRING, compartment STRING, side STRING, x INT, y INT, z INT")
    spacing = grid(spark, ["0001", "0002", "0003", "0004", "0005"], (1.0, 1.0, 2.0))
    volumes = geometry.surface_volumes(surface, spacing)
    assert [r.top for r in volumes.orderBy("subject_id").collect()] == [0, 2, 4, 8]
    got = geometry.nearest_surface(surface, spacing).collect()
    assert {(r.subject_id, r.side, (r.x, r.y, r.z)): pytest.approx(r.distance_mm, abs=1e-9) for r in got} == want
    assert geometry.nearest_surface(surface.where("subject_id = '0005'"), spacing).collect() == []


@pytest.mark.parametrize("gap", [2, 511])
def test_box_pairs_of_a_large_grid_are_bounded(spark, gap):
    """Two sheets across a 512^3 grid: pairs grow with the boxes of a sheet, not with their square."""
    sheet = spark.range(256 * 256).select(
        F.lit("0001").alias("subject_id"), F.lit("WT").alias("compartment"),
        (F.floor(F.col("id") / 256) * 2 + 1).cast("int").alias("y"), (F.col("id") % 256 * 2 + 1).cast("int").alias("z"))
    surface = sheet.withColumns({"side": F.lit("pred"), "x": F.lit(0)}).unionByName(
        sheet.withColumns({"side": F.lit("ref"), "x": F.lit(gap)}))
    volumes = geometry.surface_volumes(surface, grid(spark, ["0001"], (1.0, 1.0, 1.0)))
    assert volumes.first().top == 8
    points = geometry.surface_points(surface, volumes)
    for level in (8, 6, 4, 2):
        boxes = 2 * (512 >> level) ** 2
        assert geometry.met_boxes(points, [8], geometry.BOX_LEVELS, level).count() <= 25 * boxes
    far = geometry.nearest_surface(surface, grid(spark, ["0001"], (1.0, 1.0, 1.0)))
    assert [tuple(r) for r in far.groupBy("distance_mm").count().collect()] == [(float(gap), 2 * 256 * 256)]


def test_best_slice_ties_go_to_the_lowest_plane_and_empty_to_the_middle(spark):
    cells = volume(spark, {"0001": (block((1, 1, 4), (3, 3, 6)), set()), "0002": ({(0, 0, 0)}, set())})
    shapes = spark.createDataFrame(
        [("0001", [20, 20, 10]), ("0002", [20, 20, 10]), ("0003", [20, 20, 10])],
        "subject_id STRING, shape ARRAY<INT>")
    got = {r.subject_id: (r.plane, r.voxels) for r in geometry.best_slices(cells, shapes, cells.pred > 0).collect()}
    assert got == {"0001": (4, 4), "0002": (0, 1), "0003": (5, 0)}


def test_repeated_voxels_change_no_surface(spark):
    pred, ref = block((2, 2, 2), (7, 7, 7)), block((3, 3, 3), (6, 6, 6))
    once = volume(spark, {"s": (pred, ref)})
    masks = {"pred": F.col("pred") > 0, "ref": F.col("ref") > 0, "none": F.lit(False)}

    def surfaces(df):
        return {(r.mask, r.x, r.y, r.z) for r in geometry.surface_voxels(df, masks).collect()}

    want = {("pred", *v) for v in brute_surface(pred)} | {("ref", *v) for v in brute_surface(ref)}
    assert surfaces(once) == want
    assert surfaces(once.union(once).union(once.where("x = 4"))) == want


def test_small_surfaces_meet_in_arrays_and_make_no_rows_of_pairs(spark, monkeypatch):
    def no_boxes(*_):
        raise AssertionError("boxes of small surfaces")

    want = brute_distances(brute_surface(A), brute_surface(B), (0.7, 1.3, 2.9))
    rows = [(s, "ET", side, *v) for s in ("0001", "0002") for side, m in (("pred", A), ("ref", B)) for v in brute_surface(m)]
    surface = spark.createDataFrame(
        rows + [("0003", "ET", "ref", 1, 1, 1)], "subject_id STRING, compartment STRING, side STRING, x INT, y INT, z INT")
    spacing = grid(spark, ["0001", "0002", "0003"], (0.7, 1.3, 2.9))
    monkeypatch.setattr(geometry, "DIRECT_VOLUMES", 1)
    monkeypatch.setattr(geometry, "met_boxes", no_boxes)
    got = geometry.nearest_surface(surface, spacing).collect()
    for subject in ("0001", "0002"):
        assert {(r.side, (r.x, r.y, r.z)): pytest.approx(r.distance_mm, abs=1e-9) for r in got if r.subject_id == subject} == want
    assert len(got) == 2 * len(want)
