"""Surfaces, surface distances, and the placement of masks on their grid."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtally.constants import COMPARTMENTS, WHOLE_TUMOR_CODE
from voxtally.functions.columns import by_shuffle, computed_once
from voxtally.functions.labels import in_compartment, two_stage_label
from voxtally.operators.agreement import confusion_counts, overlap_metrics
from voxtally.session import cut_lineage

AXES = ("x", "y", "z")
SIDES = ("pred", "ref")


def surface_voxels(voxels: DataFrame, masks: Mapping[str, Column]) -> DataFrame:
    """(subject_id, mask, x, y, z) of every foreground voxel with a background 6-neighbour.

    All masks (at most eight, the documented limit) share one shuffle: a voxel sends one
    number to itself and to its six neighbours, with six bits per mask of which each
    direction sets its own, and, to itself, one bit per mask. Joined by OR they tell which
    neighbours a voxel has in each mask, so a voxel that occurs twice counts once and
    belongs to every mask that any of its rows is in. Positions outside the grid never send
    anything, so the edge counts as background.
    """
    names = list(masks)
    if len(names) > 8:
        raise ValueError("at most eight masks at a time")
    own_shift = 6 * len(names)
    near = sum((F.when(masks[n], F.lit(1 << (6 * i))).otherwise(0).cast("bigint")
                for i, n in enumerate(names)), F.lit(0).cast("bigint"))
    own = sum((F.when(masks[n], F.lit(1 << (own_shift + i))).otherwise(0).cast("bigint")
               for i, n in enumerate(names)), F.lit(0).cast("bigint"))
    marked = computed_once(voxels, {"near": near, "own": own}).select(
        "subject_id", *AXES, "near", "own").where(F.col("own") > 0)
    steps = [tuple(s if a == b else 0 for b in range(3)) for a in range(3) for s in (-1, 1)]
    sent = marked.selectExpr("subject_id", "inline(array(struct(x, y, z, own AS bits), {}))".format(", ".join(
        f"struct(x + {dx} AS x, y + {dy} AS y, z + {dz} AS z, shiftleft(near, {d}) AS bits)"
        for d, (dx, dy, dz) in enumerate(steps))))
    total = sent.groupBy("subject_id", *AXES).agg(F.bit_or("bits").alias("bits"))
    kept = total.selectExpr("subject_id", *AXES, "inline(filter(array({}), s -> s.hit))".format(
        ", ".join(
            f"struct('{n}' AS mask, (shiftright(bits, {own_shift + i}) & 1) = 1 "
            f"AND (shiftright(bits, {6 * i}) & 63) < 63 AS hit)"
            for i, n in enumerate(names))))
    return kept.select("subject_id", "mask", *AXES)


def paired_surfaces(cells: DataFrame, compartments: Sequence[str] = COMPARTMENTS) -> DataFrame:
    """Surfaces of both label maps: (subject_id, compartment, side, x, y, z)."""
    masks = {
        f"{side}:{c}": in_compartment(F.col(side), c) for side in SIDES for c in compartments
    }
    surface = surface_voxels(cells, masks)
    part = F.split("mask", ":")
    return surface.select(
        "subject_id", F.get(part, F.lit(1)).alias("compartment"),
        F.get(part, F.lit(0)).alias("side"), *AXES)


GROUP = ["subject_id", "compartment"]


# Edges of boxes, as powers of two voxels, that a volume's octree may use.
BOX_LEVELS = (18, 16, 14, 12, 10, 8, 6, 4, 2, 0)
ROOT_BOXES = 4  # along an axis, at most, where a volume's octree starts
DIRECT_PAIRS = 1 << 20  # voxels of one side times those of the other, compared without boxes
DIRECT_SIDE = 1 << 11  # voxels of a side compared so, which bounds the arrays of a batch
DIRECT_VOLUMES = 256  # volumes whose places a task holds at once
DISTANCES = "subject_id string, compartment string, side string, x int, y int, z int, distance_mm double"


def _cell(level: int) -> Column:
    """The cell of edge 2^level in one number, 21 bits an axis."""
    x, y, z = (f"CAST(shiftright({a}, {level}) AS BIGINT)" for a in AXES)
    return F.expr(f"shiftleft({x}, 42) | shiftleft({y}, 21) | {z}")


def _boxes(points: DataFrame, tag: str, level: int, parent: int) -> DataFrame:
    """Occupied cells of edge 2^level, the cell of edge 2^parent each lies in, and the bounding
    box, in mm, of what it holds. ``side`` is that of the query voxels: ``t`` boxes hold the
    other one."""
    side = F.col("side") if tag == "q" else ~F.col("side")
    keys = ["volume", "top", side.alias("side"), _cell(parent).alias(f"{tag}_in"), _cell(level).alias(f"{tag}_cell")]
    ends = [(F.col(f"{a}_mm"), f"{tag}_{a}_{n}", f) for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]
    if level == 0:
        return points.select(*keys, *[c.alias(name) for c, name, _ in ends])
    return points.groupBy(*keys).agg(*[f(c).alias(name) for c, name, f in ends])


def _squared(gap: str) -> str:
    """Sum over the axes of a gap times itself; ``pow`` would be far slower."""
    return " + ".join(f"({gap}) * ({gap})".replace("@", a) for a in AXES)


_NEAR2 = _squared("greatest(t_@_lo - q_@_hi, q_@_lo - t_@_hi, 0.0D)")
_FAR2 = _squared("greatest(t_@_hi - q_@_lo, q_@_hi - t_@_lo)")
_POINT2 = _squared("t_@_lo - q_@_lo")


def surface_volumes(surface: DataFrame, spacing: DataFrame, levels: Sequence[int] = BOX_LEVELS) -> DataFrame:
    """One row per (subject, compartment) with both sides: a number, the lower corner, the voxel
    size, and ``top``, the smallest level at which no axis has more than ``ROOT_BOXES`` boxes,
    or 0 where the surfaces make at most ``DIRECT_PAIRS`` pairs of ``DIRECT_SIDE`` voxels a side."""
    ends = [F.min(a).alias(f"{a}0") for a in AXES]
    extent = F.greatest(*[F.max(a) - F.min(a) for a in AXES]).alias("extent")
    sides = [F.count_if(F.col("side") == side).alias(f"n_{side}") for side in SIDES]
    found = surface.groupBy(*GROUP).agg(*ends, extent, *sides)
    top = F.lit(max(levels))
    for level in sorted(levels, reverse=True):
        top = F.when(F.expr(f"shiftright(extent, {level})") < ROOT_BOXES, level).otherwise(top)
    pred, ref = (F.col(f"n_{side}") for side in SIDES)
    direct = (pred * ref <= DIRECT_PAIRS) & (F.greatest(pred, ref) <= DIRECT_SIDE)
    top = F.when(direct, 0).otherwise(top)
    mm = spacing.select("subject_id", *[
        F.get("voxel_size_mm", F.lit(i)).alias(f"s{a}") for i, a in enumerate(AXES)])
    return found.where((pred > 0) & (ref > 0)).join(mm, "subject_id").select(
        F.monotonically_increasing_id().alias("volume"), *GROUP, top.alias("top"),
        *[f"{a}0" for a in AXES], *[f"s{a}" for a in AXES])


def surface_points(surface: DataFrame, volumes: DataFrame) -> DataFrame:
    """Surface voxels under their volume's number, from its lower corner, with their place in mm."""
    return by_shuffle(surface).join(volumes, GROUP).select(
        "volume", "top", (F.col("side") == SIDES[0]).alias("side"),
        *[(F.col(a) - F.col(f"{a}0")).alias(a) for a in AXES],
        *[(F.col(a) * F.col(f"s{a}")).alias(f"{a}_mm") for a in AXES])


def met_boxes(points: DataFrame, tops: Sequence[int], levels: Sequence[int], finest: int = 0) -> DataFrame:
    """Pairs of boxes of edge 2^finest, or of voxels at 0, that may hold a nearest voxel.

    A volume enters at its ``top``, where all boxes of both sides meet: at most
    ``ROOT_BOXES`` ** 6 pairs, or ``DIRECT_PAIRS`` of voxels, and as many for the other side.
    Below, the parts of a pair meet.
    """
    used = [level for level in sorted(levels, reverse=True) if finest <= level <= max(tops, default=0)]
    pairs = None
    for level, parent in zip(used, (used[0], *used)):
        inside = points.where(F.col("top") >= level)
        q, t = _boxes(inside, "q", level, parent), _boxes(inside, "t", level, parent).drop("top")
        met = None
        if level in tops:
            met = q.where(F.col("top") == level).join(t, ["volume", "side"]).withColumn("bound", F.lit(float("inf")))
        if pairs is not None:
            opened = pairs.join(q.where(F.col("top") > level), ["volume", "side", "q_in"]).join(
                t, ["volume", "side", "t_in"])
            met = opened if met is None else met.unionByName(opened)
        if level == 0:
            return met
        met = met.withColumn("near2", F.expr(_NEAR2)).where(F.col("near2") <= F.col("bound"))
        of_query = W.partitionBy("volume", "side", "q_cell")
        kept = met.withColumn("bound", F.least("bound", F.min(F.expr(_FAR2)).over(of_query))).where(
            F.col("near2") <= F.col("bound"))
        pairs = kept.select(
            "volume", "side", "bound", F.col("q_cell").alias("q_in"), F.col("t_cell").alias("t_in"))
    return pairs


def compared_directly(surface: DataFrame, volumes: DataFrame) -> DataFrame:
    """``DISTANCES`` of the volumes that start at level 0: both sides of one in one row, all its
    pairs in one product of arrays, so that no pair becomes a row."""
    held = by_shuffle(surface).join(volumes.where("top = 0").drop("volume", "top"), GROUP)
    cell = _cell(0)
    moved = held.withColumns({a: F.col(a) - F.col(f"{a}0") for a in AXES}).select(
        *GROUP, "side", cell.alias("cell"), *[f"{a}0" for a in AXES], *[f"s{a}" for a in AXES])
    once = [F.first(c).alias(c) for a in AXES for c in (f"{a}0", f"s{a}")]
    rows = moved.groupBy(*GROUP).agg(
        *once, *[F.collect_set(F.when(F.col("side") == s, F.col("cell"))).alias(s) for s in SIDES])

    few = DIRECT_VOLUMES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nearest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            of_a, of_b, step = [], np.full(b.shape[1], np.inf), max(1, (1 << 16) // b.shape[1])
            for at in range(0, a.shape[1], step):
                x, y, z = (p[at : at + step, None] - t for p, t in zip(a, b))
                square = x * x + y * y + z * z
                of_a.append(square.min(axis=1))
                np.minimum(of_b, square.min(axis=0), out=of_b)
            return np.concatenate(of_a), of_b

        for batch in (b.slice(at, few) for b in batches for at in range(0, b.num_rows, few)):
            corner = np.stack([batch.column(f"{a}0").to_numpy() for a in ("x", "y", "z")])
            size = np.stack([batch.column(f"s{a}").to_numpy() for a in ("x", "y", "z")])
            ends, places = {}, {}
            for side in ("pred", "ref"):
                column = batch.column(side)
                ends[side] = column.offsets.to_numpy() - column.offsets[0].as_py()
                cells = column.flatten().to_numpy()
                owner = np.repeat(np.arange(batch.num_rows), np.diff(ends[side]))
                places[side] = owner, np.stack([cells >> 42, (cells >> 21) & 2097151, cells & 2097151]) + corner[:, owner]
            mm = {side: place * size[:, owner] for side, (owner, place) in places.items()}
            found = {side: np.empty(at.shape[1]) for side, at in mm.items()}
            for i in range(batch.num_rows):
                p, r = (slice(ends[side][i], ends[side][i + 1]) for side in ("pred", "ref"))
                found["pred"][p], found["ref"][r] = nearest(mm["pred"][:, p], mm["ref"][:, r])
            for side, (owner, place) in places.items():
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(pa.array(owner)) for c in ("subject_id", "compartment")],
                     pa.array(np.full(len(owner), side, object), pa.string()),
                     *[pa.array(p.astype(np.int32)) for p in place], pa.array(np.sqrt(found[side]))],
                    names=["subject_id", "compartment", "side", "x", "y", "z", "distance_mm"])

    return rows.mapInArrow(run, DISTANCES)


def nearest_surface(
    surface: DataFrame, spacing: DataFrame, *, levels: Sequence[int] = BOX_LEVELS
) -> DataFrame:
    """Exact distance in mm from every surface voxel to the nearest one of the other side.

    Small surfaces are compared directly. Of the others, both surfaces of a volume are boxed by
    an octree that starts at a level fitting the volume's own extent. From coarse to fine, a pair of boxes survives only while its least
    possible distance does not exceed the best guaranteed distance of the query box, so no
    candidate that could be nearest is lost and far-apart voxels are never compared one by
    one. ``spacing`` holds (subject_id, voxel_size_mm). A voxel whose other side is empty
    gets no row.
    """
    if levels[-1] != 0 or list(levels) != sorted(levels, reverse=True):
        raise ValueError("levels must fall to 0")
    surface = cut_lineage(surface)
    volumes = cut_lineage(surface_volumes(surface, spacing, levels))
    tops = [r.top for r in volumes.where("top > 0").select("top").distinct().collect()]
    small = compared_directly(surface, volumes)
    if not tops:
        return small
    points = cut_lineage(surface_points(surface, volumes.where("top > 0")))
    nearest = met_boxes(points, tops, levels).withColumn("near2", F.expr(_POINT2)).groupBy(
        "volume", "side", "q_cell").agg(F.min("near2").alias("near2"))
    place = {a: F.expr(f"CAST(shiftright(q_cell, {shift}) & 2097151 AS INT)") + F.col(f"{a}0")
             for a, shift in zip(AXES, (42, 21, 0))}
    return nearest.join(volumes, "volume").select(
        *GROUP, F.when(F.col("side"), SIDES[0]).otherwise(SIDES[1]).alias("side"),
        *[place[a].alias(a) for a in AXES], F.sqrt("near2").alias("distance_mm")).unionByName(small)


def surface_distance_percentile(
    distances: DataFrame, counts: DataFrame, percentile: float = 95.0
) -> DataFrame:
    """Symmetric percentile distance per (subject, compartment).

    NULL when both masks are empty, Infinity when one is. Equal distances are counted
    before the percentile, so a volume contributes its few distinct distances.
    """
    freq = distances.groupBy(*GROUP, "side", "distance_mm").agg(F.count(F.lit(1)).alias("n"))
    directed = freq.groupBy(*GROUP, "side").agg(
        F.percentile("distance_mm", percentile / 100.0, F.col("n")).alias("d"))
    worst = directed.groupBy(*GROUP).agg(F.max("d").alias("hausdorff_mm"))
    pred, ref = F.col("n_pred") > 0, F.col("n_ref") > 0
    return counts.join(worst, GROUP, "left").select(
        *GROUP,
        F.when(~pred & ~ref, F.lit(None).cast("double"))
        .when(pred != ref, F.lit(float("inf")))
        .otherwise(F.col("hausdorff_mm")).alias("hausdorff_mm"),
    )


def hausdorff(cells: DataFrame, grids: DataFrame, *, percentile: float = 95.0) -> DataFrame:
    """Percentile surface distance of both label maps for every volume and compartment."""
    counts = confusion_counts(cells, grids=grids)
    distances = nearest_surface(paired_surfaces(cells), grids)
    return surface_distance_percentile(distances, counts, percentile)


def paired_metrics(cells: DataFrame, grids: DataFrame, voxel_mm3: Column | float = 1.0) -> DataFrame:
    """The full bundle per volume and compartment, one row each."""
    mm3 = "voxel_volume_mm3" if "voxel_volume_mm3" in grids.columns else None
    counts = confusion_counts(cells, grids=grids)
    if mm3:
        counts = counts.join(grids.select("subject_id", mm3), "subject_id")
        voxel_mm3 = F.col(mm3)
    overlap = overlap_metrics(counts, voxel_mm3)
    far = hausdorff(cells, grids).withColumnRenamed("hausdorff_mm", "hd95_mm")
    return overlap.join(far, GROUP).select(
        *GROUP, "dice", "hd95_mm", "abs_volumetric_error_mm3", "sensitivity", "specificity")


# ------------------------------------------------------------------ placement

def reoriented(voxels: DataFrame, transform: DataFrame, shape: str = "shape") -> DataFrame:
    """Voxel coordinates in another orientation.

    ``transform`` has per subject ``shape`` and, for each new axis, the old axis it comes
    from (``source``, 0-2) and its direction (``flip``, 1 or -1). Values ride along.
    """
    old = F.array(*AXES)
    joined = by_shuffle(voxels).join(transform.select("subject_id", shape, "source", "flip"), "subject_id")

    def axis(i: int) -> Column:
        src = F.get("source", F.lit(i))
        c = F.get(old, src)
        return F.when(F.get("flip", F.lit(i)) == -1, F.get(shape, src) - 1 - c).otherwise(c)

    moved = joined.withColumns({f"_n{a}": axis(i) for i, a in enumerate(AXES)})
    return moved.drop(*AXES, shape, "source", "flip").withColumnsRenamed(
        {f"_n{a}": a for a in AXES})


def display_slice(voxels: DataFrame, planes: DataFrame, grids: DataFrame) -> DataFrame:
    """Axial planes (subject_id, z) with row and column as a radiologist sees them."""
    size = grids.select("subject_id", F.get("shape", F.lit(0)).alias("_i"),
                        F.get("shape", F.lit(1)).alias("_j"))
    cut = voxels.join(planes.select("subject_id", "z"), ["subject_id", "z"], "left_semi")
    return by_shuffle(cut).join(size, "subject_id").withColumns({
        "row": F.col("_j") - 1 - F.col("y"),
        "col": F.col("_i") - 1 - F.col("x"),
    }).drop("_i", "_j")


def centroids(voxels: DataFrame, grids: DataFrame, mask: Column) -> DataFrame:
    """Rounded mean voxel of a mask, the grid centre when it is empty; ties round to even."""
    mean = voxels.where(mask).groupBy("subject_id").agg(*[
        F.bround(F.avg(a), 0).cast("int").alias(f"m{a}") for a in AXES])
    return grids.select("subject_id", "shape").join(mean, "subject_id", "left").select(
        "subject_id", *[
            F.coalesce(F.col(f"m{a}"), F.floor(F.get("shape", F.lit(i)) / 2).cast("int")).alias(a)
            for i, a in enumerate(AXES)
        ])


def flagged_slices(voxels: DataFrame, flagged: DataFrame, centre: DataFrame, grids: DataFrame) -> DataFrame:
    """Display slices through the centroid, for flagged subjects only."""
    planes = centre.join(flagged.select("subject_id"), "subject_id", "left_semi")
    return display_slice(voxels, planes, grids)


def best_slices(voxels: DataFrame, grids: DataFrame, mask: Column) -> DataFrame:
    """Plane with most mask voxels along the shortest axis; middle plane when empty."""
    axis = F.array_position(F.col("shape"), F.array_min("shape")) - 1
    size = grids.select("subject_id", axis.cast("int").alias("axis"), F.array_min("shape").alias("n"))
    place = F.get(F.array(*AXES), F.col("axis"))
    planes = (
        by_shuffle(voxels.where(mask)).join(size, "subject_id")
        .groupBy("subject_id", place.alias("plane")).agg(F.count(F.lit(1)).alias("voxels"))
    )
    best = planes.groupBy("subject_id").agg(
        F.max(F.struct("voxels", (-F.col("plane")).alias("neg"))).alias("best"))
    return size.join(best, "subject_id", "left").select(
        "subject_id", "axis",
        F.coalesce(-F.col("best.neg"), F.floor(F.col("n") / 2).cast("int")).alias("plane"),
        F.coalesce("best.voxels", F.lit(0)).alias("voxels"),
    )


def two_stage_map(whole: DataFrame, inner: DataFrame) -> DataFrame:
    """One label map from a whole-tumor map and an inner map of the same grid.

    A volume whose whole map never holds the tumor code aborts the job.
    """
    keys = ["subject_id", *AXES]
    sizes = whole.groupBy("subject_id").agg(
        F.count_if(F.col("whole") == WHOLE_TUMOR_CODE).alias("_n"))
    joined = by_shuffle(by_shuffle(whole).join(inner, keys, "left")).join(sizes, "subject_id")
    label = two_stage_label(F.col("whole"), F.coalesce("inner", F.lit(0)))
    return joined.select(*keys, F.when(
        F.col("_n") == 0,
        F.raise_error(F.concat(F.lit("no whole-tumor voxels for subject "), F.col("subject_id"))),
    ).otherwise(label).alias("label"))
