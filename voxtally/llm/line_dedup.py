"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import once, row_key, text_of

LINES = 3
KEY = ("__k0", "__k1", "__k2")


def lines(text: Column) -> Column:
    return F.split(text_of(text), "\n", -1)


def windows(documents: DataFrame, size: int = LINES) -> DataFrame:
    """One row per window of ``size`` consecutive lines: row key, ``pos``, 128 bits of hash.

    A window without a word is no passage and is left out.
    """
    def hashed(rows: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(rows) - size),
            lambda i: F.struct(
                i.alias("pos"),
                F.xxhash64(F.lit(1), F.slice(rows, i + 1, size)).alias("h1"),
                F.xxhash64(F.lit(2), F.slice(rows, i + 1, size)).alias("h2"),
                F.exists(F.slice(rows, i + 1, size), lambda r: r["word"]).alias("word"),
            ),
        )

    # A line's own hash is taken once, not for each window that holds it.
    line = F.transform(
        lines(F.col("text")),
        lambda x: F.struct(
            F.xxhash64(F.lit(1), x).alias("a"),
            F.xxhash64(F.lit(2), x).alias("b"),
            x.rlike(r"[^\x20\x09-\x0D]").alias("word"),
        ),
    )
    spans = F.when(
        F.size(lines(F.col("text"))) >= size, once(line, hashed)
    )
    return (
        documents.select(*row_key(documents), F.explode(spans).alias("w"))
        .select(*KEY, "w.pos", "w.h1", "w.h2", "w.word")
        .where("word").drop("word")
    )


def repeats(found: DataFrame) -> DataFrame:
    """Window occurrences that are not the first of their hash by doc_id and position.

    Counting and the first occurrence are one aggregate, combined on the map side; a hash
    that a third of all rows share costs one row per map task. Only repeated hashes meet the
    windows again, in a plain join whose skewed partitions adaptive execution splits.
    """
    first = F.min(F.struct("__k0", "__k1", "__k2", "pos"))
    seen = (
        found.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), first.alias("first"))
        .where("n > 1")
        .select("h1", "h2", F.col("first.__k0").alias("f0"), F.col("first.__k1").alias("f1"),
                F.col("first.__k2").alias("f2"), F.col("first.pos").alias("fpos"))
    )
    is_first = (
        F.col("__k0").eqNullSafe(F.col("f0")) & (F.col("__k1") == F.col("f1"))
        & (F.col("__k2") == F.col("f2")) & (F.col("pos") == F.col("fpos"))
    )
    return found.join(seen, ["h1", "h2"]).where(~is_first).select(*KEY, "pos")


def clean(documents: DataFrame, size: int = LINES) -> DataFrame:
    """``documents`` with repeated passages taken out of ``text``, and ``n_lines``,
    ``n_removed`` (lines before, lines taken out).

    A window of ``size`` lines that occurred before, in order of doc_id and position, covers
    its lines; covered lines go, once, however many windows cover them. Texts with fewer
    lines have no window and stay. A null text has one empty line and stays null. Rows alike
    in doc_id and text are one document and keep the same lines; a null doc_id sorts first.
    Input columns named like an output are replaced; an empty table gives an empty one.
    """
    marks = (
        repeats(windows(documents, size))
        .groupBy(*KEY)
        .agg(F.collect_set("pos").alias("__pos"))  # no more than the text has lines
        .select(*[F.col(k).alias(k.replace("__k", "__m")) for k in KEY], "__pos")
    )
    keyed = documents.withColumns(dict(zip(KEY, row_key(documents))))
    joined = keyed.join(
        marks,
        F.col("__k0").eqNullSafe(F.col("__m0")) & (F.col("__k1") == F.col("__m1"))
        & (F.col("__k2") == F.col("__m2")),
        "left",
    )
    # Covered positions, merged: sorted starts, each adding what reaches beyond the last end.
    covered = F.array_sort(F.array_distinct(F.flatten(
        F.transform(F.col("__pos"), lambda p: F.sequence(p, p + size - 1))
    )))
    cleaned = once(
        F.struct(lines(F.col("text")).alias("all"), F.coalesce(covered, F.array().cast("array<int>")).alias("gone")),
        lambda x: F.struct(
            F.array_join(F.transform(_left(x["gone"], F.size(x["all"])), lambda i: F.get(x["all"], i)), "\n").alias("text"),
            F.size(x["gone"]).alias("removed"),
        ),
    )
    return joined.withColumns({
        "n_lines": F.size(lines(F.col("text"))).cast("long"),
        "__out": F.when(F.col("__pos").isNull(), F.struct(
            F.col("text"), F.lit(0).alias("removed"))).otherwise(cleaned),
    }).withColumns({
        "text": F.col("__out.text"), "n_removed": F.col("__out.removed").cast("long"),
    }).drop("__out", "__pos", *KEY, "__m0", "__m1", "__m2")


def _left(gone: Column, n: Column) -> Column:
    return F.array_sort(F.array_except(F.sequence(F.lit(0), n - 1), gone))
