"""Connected components of a link table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to ``key``, ``root``: the smallest key reachable, one row per key.

    Every round a key takes the smallest label among itself and its neighbours, then the
    label which that one had, so long chains need few rounds. Rounds are written tables. Minima
    combine on the map side; a hub's rows meet its one label in a plain join that adaptive
    execution splits. A self-link or a repeated link changes nothing; null ends are ignored.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL")
    both = cut_lineage(
        links.select("a", "b").union(links.select("b", "a")).distinct()
    )
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("key"), F.least("a", "b").alias("root")))
    while True:
        near = (
            both.join(labels.select(F.col("key").alias("b"), "root"), "b")
            .groupBy("a").agg(F.min("root").alias("near"))
        )
        met = labels.join(near, labels["key"] == near["a"]).select(
            "key", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("key").alias("root"), F.col("root").alias("next"))
        stepped = cut_lineage(met.join(jump, "root").select(
            "key", F.col("next").alias("root"), (F.col("next") != F.col("old")).alias("moved")))
        labels = stepped.select("key", "root")
        if stepped.where("moved").isEmpty():
            return labels
