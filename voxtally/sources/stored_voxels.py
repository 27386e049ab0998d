"""Voxel tables stored in buckets, so that joins of two of them move no rows.

Rows are dealt by every join key, not by the subject alone: a large volume is spread over all
buckets, and Spark's default rule, which wants a join's keys to be the bucket's keys, holds.
Within a bucket rows are sorted by subject and position, so that a scan of one subject skips
most of each file. Sums per subject over such a join shuffle partial sums only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

VOXEL_KEYS = ("subject_id", "x", "y", "z")


def _table_name() -> str:
    return f"voxels_{uuid.uuid4().hex}"


def store_voxels(
    voxels: DataFrame, path: str, *, keys: Sequence[str] = VOXEL_KEYS, buckets: int | None = None
) -> DataFrame:
    """Write ``voxels`` below ``path`` in buckets of ``keys``, one file each, and read them back.

    Tables meant for one join need the same keys and number of buckets; choose the number so
    that a bucket fits a task. The layout is written last: a folder without it is not whole.
    """
    spark = voxels.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        voxels.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys)
        .option("path", f"{path}/voxels").format("parquet").saveAsTable(_table_name())
    )
    layout = {"keys": list(keys), "buckets": n, "schema": [[f.name, f.dataType.simpleString()] for f in voxels.schema]}
    spark.createDataFrame([(json.dumps(layout),)], "value STRING").coalesce(1).write.text(f"{path}/layout")
    return open_voxels(spark, path)


def open_voxels(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``store_voxels`` wrote, also in another session, with its buckets known."""
    layout = json.loads(spark.read.text(f"{path}/layout").first().value)
    name, keys = _table_name(), ", ".join(f"`{k}`" for k in layout["keys"])
    columns = ", ".join(f"`{c}` {kind}" for c, kind in layout["schema"])
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
        f"INTO {layout['buckets']} BUCKETS LOCATION '{path}/voxels'")
    return spark.table(name)
