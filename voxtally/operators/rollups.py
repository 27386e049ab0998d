"""Regions rolled up to lobes and functional groups, and summaries over the cohort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.constants import COMPARTMENTS, FUNCTIONAL_GROUPS, LOBES, TERTILES
from voxtally.functions.text import hemisphere, lobe, stem
from voxtally.operators.order_statistics import exact_percentiles
from voxtally.session import cut_lineage

LOBE_IDS = tuple(f"lobe:{name}" for name in LOBES)
GROUP_LABELS = {
    **{f"lobe:{name}": (f"lobe: {name}", "lobar") for name in LOBES},
    **{g: (label, "functional-adjacency") for g, label, _, _ in FUNCTIONAL_GROUPS},
}
GROUP_IDS = tuple(GROUP_LABELS)


def functional_member(name: Column, group_id: str) -> Column:
    """Whether a region name belongs to one functional-adjacency group."""
    side, stems = next((h, s) for g, _, h, s in FUNCTIONAL_GROUPS if g == group_id)
    hit = stem(name).isin(*stems)
    hit = hit if side is None else hit & (hemisphere(name) == side)
    return F.coalesce(hit, F.lit(False))


def region_groups(regions: DataFrame, name: str = "name") -> DataFrame:
    """One row per (region, group): always its lobe, and every functional group it is in."""
    column = F.col(name)
    found = F.array(
        F.concat(F.lit("lobe:"), lobe(column)),
        *[F.when(functional_member(column, g), F.lit(g)) for g, *_ in FUNCTIONAL_GROUPS],
    )
    return regions.withColumn("group_id", F.explode(F.array_compact(found)))


def inferred_voxel_volume(table: DataFrame) -> DataFrame:
    """Median of volume over voxels where a region overlaps; 1.0 if none does.

    A subject has a few rows per region, so its group is small whatever the cohort.
    """
    ratio = F.when(F.col("overlap_voxels") > 0,
                   F.col("overlap_volume_mm3") / F.col("overlap_voxels"))
    usable = F.when(F.col("_m") > 0, F.col("_m"))
    return table.groupBy("subject_id").agg(F.percentile(ratio, 0.5).alias("_m")).select(
        "subject_id", F.coalesce(usable, F.lit(1.0)).alias("voxel_volume_mm3"))


def _per_label(table: DataFrame) -> DataFrame:
    """One row per (subject, label): its size once, its volume per compartment."""
    return table.groupBy("subject_id", "label").agg(
        F.max("name").alias("name"),
        F.coalesce(F.max("parcel_voxels"), F.lit(0)).alias("parcel_voxels"),
        *[
            F.sum(F.when(F.col("compartment") == c,
                         F.coalesce("overlap_volume_mm3", F.lit(0.0))).otherwise(0.0)).alias(c)
            for c in COMPARTMENTS
        ],
    )


def _rollup(table: DataFrame, members: Mapping[str, Column], key: str, size: str) -> DataFrame:
    """Dense (group x compartment) cells per subject from one conditional aggregate.

    Every group is a column of the aggregate, so empty cells come out as zeros and the
    overlapping groups need no fan-out; the compartment total is taken over the regions.
    """
    names = list(members)
    marked = _per_label(table).withColumn("_lobe", lobe(F.col("name"))).select(
        "subject_id", "parcel_voxels", *COMPARTMENTS,
        *[members[name].alias(f"_in_{i}") for i, name in enumerate(names)],
    )
    sums = [F.expr(f"sum({c}) AS _all_{c}") for c in COMPARTMENTS]
    for i in range(len(names)):
        sums.append(F.expr(f"sum(if(_in_{i}, parcel_voxels, 0)) AS _size_{i}"))
        sums += [F.expr(f"sum(if(_in_{i}, {c}, 0.0D)) AS _{c}_{i}") for c in COMPARTMENTS]
    wide = marked.groupBy("subject_id").agg(*sums)
    wide = wide.join(inferred_voxel_volume(table), "subject_id")
    long = wide.selectExpr("subject_id", "voxel_volume_mm3", "inline(array({}))".format(", ".join(
        f"struct('{name}' AS {key}, '{c}' AS compartment, _size_{i} AS _size, "
        f"_{c}_{i} AS overlap_volume_mm3, _all_{c} AS _total)"
        for i, name in enumerate(names) for c in COMPARTMENTS)))
    volume = F.col("_size") * F.col("voxel_volume_mm3")
    overlap = 100.0 * F.col("overlap_volume_mm3")
    return long.select(
        "subject_id", key, "compartment", volume.alias(size), "overlap_volume_mm3",
        F.try_divide(overlap, volume).alias("share_of_group_pct"),
        F.try_divide(overlap, F.col("_total")).alias("share_of_compartment_pct"),
    )


def lobe_cells(table: DataFrame) -> DataFrame:
    """Every (subject, lobe, compartment) with its volume and both shares."""
    members = {name: F.col("_lobe") == name for name in LOBES}
    return _rollup(table, members, "lobe", "lobe_volume_mm3").withColumnRenamed(
        "share_of_group_pct", "share_of_lobe_pct")


def group_cells(table: DataFrame, tertiles: DataFrame | None = None) -> DataFrame:
    """Every (subject, group, compartment); functional groups overlap each other."""
    members: dict[str, Column] = {f"lobe:{name}": F.col("_lobe") == name for name in LOBES}
    members.update({g: functional_member(F.col("name"), g) for g, *_ in FUNCTIONAL_GROUPS})
    cells = _rollup(table, members, "group_id", "group_volume_mm3")
    labels = F.create_map(*[F.lit(x) for g, (text, _) in GROUP_LABELS.items() for x in (g, text)])
    kinds = F.create_map(*[F.lit(x) for g, (_, kind) in GROUP_LABELS.items() for x in (g, kind)])
    cells = cells.withColumns({
        "group_label": labels[F.col("group_id")],
        "group_type": kinds[F.col("group_id")],
    })
    if tertiles is None:
        return cells
    return cells.join(tertiles.select("subject_id", "OS_tertile"), "subject_id", "left").na.fill(
        "unknown", ["OS_tertile"])


def cohort_cells(
    cells: DataFrame,
    cohort: DataFrame,
    *,
    key: str = "lobe",
    groups: Sequence[str] = LOBES,
    share: str = "share_of_lobe_pct",
    contexts: Sequence[str] = ("all",),
) -> DataFrame:
    """Prevalence, volume and share quartiles per (context, group, compartment).

    ``cells`` is dense: a subject with a table has a row for every cell. ``cohort`` lists
    every subject (with ``OS_tertile`` when contexts other than ``all`` are wanted):
    prevalence divides by its size, subjects without a table included.
    """
    tertile = F.col("OS_tertile") if len(contexts) > 1 else F.lit(None).cast("string")
    place = F.array_intersect(
        F.array_compact(F.array(F.lit("all"), tertile)), F.array(*[F.lit(c) for c in contexts]))
    needed = [key, "compartment", "overlap_volume_mm3", share, "share_of_compartment_pct"]
    if len(contexts) > 1:
        needed.append("OS_tertile")
    rows = cut_lineage(cells.select(*needed).withColumn("context", F.explode(place)))
    sizes = cohort.withColumn("context", F.explode(place)).groupBy("context").agg(
        F.count(F.lit(1)).alias("n_total"))

    keys = ["context", key, "compartment"]
    present = F.col("overlap_volume_mm3") > 0
    counts = rows.groupBy(*keys).agg(
        F.count_if(present).alias("n_with_overlap"),
        F.count(F.lit(1)).alias("n_with_table"),
        F.sum("overlap_volume_mm3").alias("total_overlap_volume_mm3_sum"),
    )
    # Both shares go through one exact pass, told apart by `measure`.
    measures = rows.select(*keys, F.inline(F.array(
        F.struct(F.lit("soc").alias("measure"), F.col("share_of_compartment_pct").alias("v")),
        F.struct(F.lit("sog").alias("measure"), F.when(present, F.col(share)).alias("v")),
    )))
    quartiles = exact_percentiles(
        measures, [*keys, "measure"], "v", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    pick = lambda m, q: F.max(F.when(F.col("measure") == m, F.col(q)))
    shares = quartiles.groupBy(*keys).agg(
        *[pick("soc", q).alias(f"share_of_compartment_pct_{q}") for q in ("median", "p25", "p75")],
        *[pick("sog", q).alias(f"{share}_{q}_when_present") for q in ("median", "p25", "p75")],
    )
    domain = cells.sparkSession.createDataFrame(
        [(x, g, c) for x in contexts for g in groups for c in COMPARTMENTS],
        f"context STRING, {key} STRING, compartment STRING")
    out = (
        domain.join(sizes, "context", "left")
        .join(counts, keys, "left").join(shares, keys, "left")
        .na.fill(0, ["n_total", "n_with_table", "n_with_overlap"])
        .na.fill(0.0, ["total_overlap_volume_mm3_sum"])
    )
    return out.withColumn(
        "prevalence", F.col("n_with_overlap") / F.greatest(F.col("n_total"), F.lit(1)))


def context_cells(cells: DataFrame, cohort: DataFrame) -> DataFrame:
    """Group summary for the whole cohort and for each survival tertile."""
    return cohort_cells(
        cells, cohort, key="group_id", groups=GROUP_IDS, share="share_of_group_pct",
        contexts=("all", *TERTILES))
