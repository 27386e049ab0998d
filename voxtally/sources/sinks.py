"""Sinks: CSV tables, nested JSON summaries, and writes that skip what exists."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.session import cut_lineage


def write_csv(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def summary_document(
    cells: DataFrame, problems: DataFrame, *, schema_version: str = "1.0"
) -> DataFrame:
    """One JSON row: version, counts, summary cells and problems.

    Both inputs are reports (a fixed grid of cells, one row per rejected input), not data.
    """
    body = cells.agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.array_sort(F.collect_list(F.struct(*cells.columns))).alias("cells"),
    )
    rejects = problems.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_problems"),
        F.array_sort(F.collect_list(F.struct("reason", "n"))).alias("problems"),
    )
    merged = body.select(
        F.lit(schema_version).alias("schema_version"), "n_cells", "cells",
        rejects.select(F.struct("n_problems", "problems")).scalar().alias("_r"))
    return merged.select(F.to_json(F.struct(
        "schema_version", "n_cells", F.col("_r.n_problems").alias("n_problems"), "cells",
        F.col("_r.problems").alias("problems"))).alias("value"))


def write_json_summary(document: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    document.write.mode(mode).text(path)


def pack_files(files: DataFrame, path: str) -> None:
    """Keep files (path, content) as rows of Parquet, many to a container, beside their length
    and time, in the columns of Spark's ``binaryFile``. A million volumes are then not a million
    files, whose making and listing cost one call of the file system each."""
    files.select("path", F.current_timestamp().alias("modificationTime"),
                 F.octet_length("content").cast("bigint").alias("length"), "content").write.parquet(path)


def still_to_do(wanted: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that have no output yet."""
    return wanted.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """Adds ``bucket``, a hash of the keys, for partitions whose number does not grow with the
    keys; rows of a bucket come together, so that each gets few files."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).repartition("bucket")


def _written(spark: SparkSession, path: str, keys: str) -> DataFrame:
    return spark.read.schema(f"{keys}, run STRING").option("ignoreMissingFiles", "true").parquet(f"{path}/written/*")


def write_missing(df: DataFrame, path: str, keys: Sequence[str], *, buckets: int = 64) -> int:
    """Write the rows of keys that ``path`` does not hold yet; returns how many keys those are.

    Rows lie in ``buckets`` partitions, whatever the number of keys. A run writes its rows
    first and the list of its keys last, under its own name; rows count only where their key is
    listed for their run, so what a broken run left behind is passed over and done again.
    """
    spark, keys, run = df.sparkSession, list(keys), uuid.uuid4().hex
    types = dict(df.dtypes)
    listed = ", ".join(f"`{k}` {types[k]}" for k in keys)
    # An empty list of its own run makes the folder one that can be read.
    df.limit(0).select(*keys, F.lit(run).alias("run")).write.parquet(f"{path}/written/opened-{run}")
    wanted = df.select(*keys).distinct()
    todo = cut_lineage(still_to_do(wanted, _written(spark, path, listed), keys))
    n = todo.count()
    if n:
        rows = df.join(todo, keys, "left_semi").withColumn("run", F.lit(run))
        bucketed(rows, keys, buckets).write.mode("append").partitionBy("bucket").parquet(f"{path}/rows")
        todo.withColumn("run", F.lit(run)).write.parquet(f"{path}/written/{run}")
    return n


def read_written(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The rows of every key that was written whole."""
    rows = spark.read.parquet(f"{path}/rows").drop("bucket")
    types = dict(rows.dtypes)
    listed = _written(spark, path, ", ".join(f"`{k}` {types[k]}" for k in keys))
    return rows.join(listed, [*keys, "run"], "left_semi").drop("run")


def missing_artefacts(expected: DataFrame, listing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned outputs that a listing does not contain."""
    return expected.select(*keys).join(listing.select(*keys), list(keys), "left_anti")
