"""Local session for tests and benchmarks, and the shared scratch folder of any session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", *, app: str = "voxtally", shuffle: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that is unset, as in tests, a temporary folder is made and remembered.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_made: list[str] = []


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one for one run's files."""
    _made.append(f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def folders_made() -> int:
    """How many run folders this process has named so far; see ``folders_since``."""
    return len(_made)


def folders_since(mark: int) -> list[str]:
    return _made[mark:]


def drop_folders(spark: SparkSession, folders: list[str]) -> None:
    """Delete run folders, and no others, that nothing reads any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        if folder in _made:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a reduced table to the shared folder once and go on from there.

    Runs a job when it is called. What follows survives the loss of executors and reads the
    table as often as it needs. The planner knows its bytes: below
    ``spark.sql.autoBroadcastJoinThreshold`` a join broadcasts it, above it does not.
    """
    path = run_folder(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
