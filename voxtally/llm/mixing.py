"""Mixing sources to target weights by repeating and drawing whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtally.llm.common import unit_draw, word_count
from voxtally.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BROADCAST_SOURCES = 10_000  # rows of the rate table, about 1 MB


def source_sizes(documents: DataFrame) -> DataFrame:
    """``source``, ``source_size``: words per source, combined on the map side."""
    return documents.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))


def ordinals(sources: DataFrame) -> DataFrame:
    """Adds ``ordinal``, the place of each distinct source by code point, null last.

    Sources are sorted by range; only the count of each range, one row per partition, is
    summed up, so no task sees all of them.
    """
    last = F.col("source").isNull()
    ranged = cut_lineage(
        sources.repartitionByRange(last, F.col("source")).withColumn("__range", F.spark_partition_id())
    )
    counts = {r["__range"]: r["n"] for r in ranged.groupBy("__range").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for part in sorted(counts):
        before += [F.lit(part), F.lit(total)]
        total += counts[part]
    if not before:
        return ranged.withColumn("ordinal", F.lit(0).cast("long")).drop("__range")
    within = F.row_number().over(Window.partitionBy("__range").orderBy(last, "source"))
    return ranged.withColumn(
        "ordinal", (F.create_map(*before)[F.col("__range")] + within - 1).cast("long")
    ).drop("__range")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``weight`` and ``target`` to ``source``, ``source_size``.

    ``share`` times all words are dealt out by weight; a target stops at ``most`` times its
    source's words and the excess is dealt again among the others by weight until no target
    is above. Each round is one aggregate over the sources; rounds end when no further
    source stops, so there are no more of them than sources. An empty table gives an empty one.
    """
    placed = cut_lineage(ordinals(sizes).withColumn(
        "weight",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("ordinal") % len(weights) + 1).cast("int")),
    ))
    most_words = F.lit(float(most)) * F.col("source_size")
    total, weight, sources = placed.agg(
        F.sum("source_size"), F.sum("weight"), F.count("*")
    ).first()
    left, open_weight, stopped = share * float(total or 0), float(weight or 0), 0
    while sources and stopped < sources:
        above = F.col("weight") * left / open_weight >= most_words
        words, closed, n = placed.where(above).agg(
            F.sum(most_words), F.sum("weight"), F.count("*")
        ).first()
        if n == stopped:
            break
        stopped = n
        left, open_weight = share * float(total) - words, float(weight) - closed
    level = F.col("weight") * F.lit(left) / F.lit(open_weight) if open_weight else most_words
    return placed.withColumn("target", F.least(level, most_words))


def mix(
    documents: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix"
) -> DataFrame:
    """``documents`` with ``size``, ``source_size``, ``target``, ``copies``, one row per document.

    ``copies`` is the whole part of target / source_size plus one more with a probability
    equal to its fraction, drawn from a hash of the seed and ``doc_id``: reruns agree on any
    layout. A source without words has rate 0. A null text has size 0; a null source is a
    source of its own. Repeated rows draw alike. Input columns named like an output are
    replaced; an empty table gives an empty one.

    The rate table has one row per source. It is broadcast when it was counted to at most
    ``BROADCAST_SOURCES``; beyond that the join sorts, and adaptive execution splits a source
    that holds many rows.
    """
    documents = documents.withColumn("size", word_count(F.col("text")))
    rates = cut_lineage(targets(source_sizes(documents), weights, share, most).select(
        F.col("source").alias("__source"),
        F.col("source_size").alias("__size"),
        F.col("target").alias("__target"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__rate"),
    ))
    side = F.broadcast(rates) if rates.count() <= BROADCAST_SOURCES else rates
    whole = F.floor("__rate")
    extra = unit_draw(seed, F.col("doc_id")) < F.col("__rate") - whole
    joined = documents.join(side, F.col("source").eqNullSafe(F.col("__source")))
    return joined.withColumns({
        "source_size": F.col("__size"),
        "target": F.col("__target"),
        "copies": (whole + extra.cast("long")).cast("long"),
    }).drop("__source", "__size", "__target", "__rate")


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as often as ``copies`` says, ``copy`` numbering its copies from 0."""
    return mixed.where("copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    )
