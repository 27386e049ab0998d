"""Incremental sidecar ingest: every new document reaches the tables exactly once.

One stream reads metric and run documents; each micro-batch is read once and feeds every
table. A table is a folder of batches, and a batch overwrites its own folder. A batch that is
repeated after a crash holds the files it held before (the checkpoint names them before it
starts), so writing it again changes nothing and the tables cannot part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.sources.sidecars import (
    metrics_long,
    parse_metric_sidecars,
    parse_run_records,
    sidecar_problems,
)

METRICS, RUNS = "metrics", "runs"
#: A document names its kind; what a kind does not use is null.
STREAM_SCHEMA = "kind STRING, subject_id STRING, pair_id STRING, stage STRING, run_id STRING, value STRING"


def document_stream(spark: SparkSession, source: str, *, files_per_batch: int | None = None) -> DataFrame:
    """Documents with ``mtime``, the modification time of their file in seconds."""
    reader = spark.readStream.schema(STREAM_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    modified = F.unix_micros("_metadata.file_modification_time") / F.lit(1e6)
    return reader.json(source).select("*", modified.alias("mtime"))


def _runs(documents: DataFrame) -> DataFrame:
    """Run records, good or not; ``run_id`` travels through the parser beside the stage."""
    parsed = parse_run_records(
        documents.where(F.col("kind") == RUNS).withColumn("stage", F.struct("stage", "run_id")))
    return parsed.withColumns({"run_id": F.col("stage.run_id"), "stage": F.col("stage.stage")})


def _metrics(documents: DataFrame) -> DataFrame:
    return parse_metric_sidecars(documents.where(F.col("kind") == METRICS).select("subject_id", "pair_id", "value"))


#: The tables and what each takes from documents; the same functions serve a batch run.
TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "metrics": lambda d: metrics_long(_metrics(d)),
    "metric_problems": lambda d: sidecar_problems(_metrics(d)),
    "runs": lambda d: _runs(d).where(F.col("reason").isNull()).drop("reason"),
    "run_problems": lambda d: _runs(d).where(F.col("reason").isNotNull()).select(
        "subject_id", "stage", "run_id", "reason"),
}


def write_part(rows: DataFrame, table: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{table}/batch={batch}")


def ingest_sidecars(
    spark: SparkSession, source: str, target: str, checkpoint: str, *, files_per_batch: int | None = None
) -> None:
    """Take in every document not seen before and stop; safe to run again after any failure."""

    def take(documents: DataFrame, batch: int) -> None:
        documents = documents.persist()
        try:
            for name, rows in TABLES.items():
                write_part(rows(documents), f"{target}/{name}", batch)
        finally:
            documents.unpersist()

    query = (
        document_stream(spark, source, files_per_batch=files_per_batch)
        .writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_ingested(spark: SparkSession, target: str, name: str) -> DataFrame:
    """One of the tables; batches that an unfinished run left half written are replaced when it
    is run again."""
    return spark.read.parquet(f"{target}/{name}").drop("batch")
