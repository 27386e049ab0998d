"""Small helpers the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: Column) -> Column:
    """A missing text reads as an empty one."""
    return F.coalesce(column, F.lit(""))


def word_count(column: Column) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def words(column: Column) -> Column:
    return F.filter(F.split(text_of(column), SPACE), lambda w: w != "")


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once: lambda variables are never inlined."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit_draw(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts only (52 bits of MD5)."""
    key = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def row_key(df: DataFrame) -> list[Column]:
    """A row is known by its id and two hashes of its text; equal rows are one row to a join."""
    return [
        F.col("doc_id").alias("__k0"),
        F.xxhash64(F.lit(1), F.col("text")).alias("__k1"),
        F.xxhash64(F.lit(2), F.col("text")).alias("__k2"),
    ]


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of a schema like ``a long, b string``; joins with it are planned away."""
    columns = [part.strip().split(" ", 1) for part in schema.split(",")]
    return spark.range(1).where(F.lit(False)).select(
        *[F.lit(None).cast(kind).alias(name) for name, kind in columns])
