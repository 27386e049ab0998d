"""JSON sidecars: metrics per subject and pair, and run records. Bad files become rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.constants import COMPARTMENTS, METRICS, SIDECAR_VERSIONS
from voxtally.functions.columns import computed_once
from voxtally.functions.numbers import (
    elapsed_seconds,
    metric_status,
    metric_value,
    quality_value,
    variant_kind,
)
from voxtally.functions.text import normalize_subject_id

DOCUMENT_SCHEMA = "subject_id STRING, pair_id STRING, value STRING"
RUN_SCHEMA = "subject_id STRING, stage STRING, value STRING"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One file per document below ``pair_id=.../subject_id=.../``."""
    return (
        spark.read.schema("value STRING, pair_id STRING, subject_id STRING")
        .text(path, wholetext=True)
        .select("subject_id", "pair_id", "value", F.col("_metadata.file_path").alias("path"),
                F.col("_metadata.file_modification_time").alias("modified"))
    )


def read_run_files(spark: SparkSession, path: str) -> DataFrame:
    """Run sidecars, one file each below ``stage=.../subject_id=.../``, with ``mtime``, the
    modification time of the file in seconds: the order in which runs ended."""
    modified = F.unix_micros("_metadata.file_modification_time") / F.lit(1e6)
    return (
        spark.read.schema("value STRING, stage STRING, subject_id STRING")
        .text(path, wholetext=True)
        .select("subject_id", "stage", "value", modified.alias("mtime"))
    )


def read_run_lines(spark: SparkSession, path: str) -> DataFrame:
    """Run sidecars of many runs per file, JSON lines of (subject_id, stage, value), with the
    file's time as ``mtime``: a file holds runs that were recorded together. The number of files
    then follows the bytes and not the runs, each of which costs ``read_run_files`` a folder."""
    modified = F.unix_micros("_metadata.file_modification_time") / F.lit(1e6)
    return spark.read.schema(RUN_SCHEMA).json(path).select("subject_id", "stage", "value", modified.alias("mtime"))


def run_records(
    documents: DataFrame, expected: DataFrame | None = None, versions: Sequence[str] = SIDECAR_VERSIONS
) -> tuple[DataFrame, DataFrame]:
    """(good records, problems) of run documents; of ``expected`` (subject_id, stage) those
    without a document are problems too. Ids are normalised before they are compared."""
    own = documents.withColumn("subject_id", normalize_subject_id(F.col("subject_id"), grown=True))
    if expected is not None:
        wanted = expected.select(
            normalize_subject_id(F.col("subject_id"), grown=True).alias("subject_id"), "stage").distinct()
        own = wanted.join(own, ["subject_id", "stage"], "left")
    parsed = parse_run_records(own, versions)
    bad = F.col("reason").isNotNull()
    return parsed.where(~bad).drop("reason"), parsed.where(bad).select("subject_id", "stage", "reason")


def read_document_lines(spark: SparkSession, path: str) -> DataFrame:
    """Many documents per file: JSON lines of (subject_id, pair_id, value)."""
    return spark.read.schema(DOCUMENT_SCHEMA).json(path)


def _at(path: str) -> Column:
    return F.try_variant_get("doc", path, "variant")


def _problem(pair: Column, metrics: Sequence[str], versions: Sequence[str]) -> Column:
    text = lambda path: F.try_variant_get("doc", path, "string")
    rules = [
        (F.col("value").isNull(), F.lit("sidecar not found")),
        (F.col("doc").isNull() | (variant_kind(F.col("doc")) != "OBJECT"),
         F.lit("could not parse JSON")),
        (_at("$.schema_version").isNull(), F.lit("missing 'schema_version'")),
        (~F.coalesce(text("$.schema_version"), F.lit("")).isin(*versions),
         F.concat(F.lit("schema_version not accepted: "),
                  F.coalesce(text("$.schema_version"), F.lit("null")))),
        (~text("$.comparison").eqNullSafe(pair),
         F.concat(F.lit("unexpected comparison: "),
                  F.coalesce(text("$.comparison"), F.lit("null")))),
        (F.coalesce(variant_kind(_at("$.metrics")), F.lit("")) != "OBJECT",
         F.lit("'metrics' must be a mapping")),
    ]
    for c in COMPARTMENTS:
        rules.append((_at(f"$.metrics.{c}").isNull(), F.lit(f"missing compartment {c}")))
        rules.append((variant_kind(_at(f"$.metrics.{c}")) != "OBJECT",
                      F.lit(f"compartment {c} must be a mapping")))
        rules += [
            (_at(f"$.metrics.{c}.{m}").isNull(), F.lit(f"missing metric {c}.{m}"))
            for m in metrics
        ]
    out = None
    for bad, reason in rules:
        out = F.when(bad, reason) if out is None else out.when(bad, reason)
    return out


def parse_metric_sidecars(
    documents: DataFrame,
    *,
    comparisons: Mapping[str, str] | None = None,
    metrics: Sequence[str] = METRICS,
    versions: Sequence[str] = SIDECAR_VERSIONS,
    strict: bool = False,
) -> DataFrame:
    """Add the parsed ``doc`` and ``reason``, the first rule the document breaks.

    A pair expects a ``comparison`` of its own name unless ``comparisons`` says otherwise.
    With ``strict`` the first bad document aborts the job.
    """
    pair = F.col("pair_id")
    if comparisons:
        lookup = F.create_map(*[F.lit(x) for item in comparisons.items() for x in item])
        pair = F.coalesce(lookup[pair], pair)
    parsed = computed_once(documents, {"doc": F.try_parse_json("value")})
    reason = _problem(pair, metrics, versions)
    if strict:
        reason = F.when(reason.isNotNull(), F.raise_error(
            F.concat(F.lit("bad sidecar of subject "), F.col("subject_id"), F.lit(": "), reason)))
    parsed = computed_once(parsed, {"reason": reason})
    own_id = F.try_variant_get("doc", "$.subject_id", "string")
    return parsed.withColumn(
        "subject_id",
        F.when(F.col("reason").isNull(),
               normalize_subject_id(F.coalesce(own_id, F.col("subject_id")), grown=True))
        .otherwise(F.col("subject_id")),
    )


def sidecar_problems(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select("subject_id", "pair_id", "reason")


def metrics_long(parsed: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per (subject, pair, compartment, metric) of every good document."""
    leaves = parsed.where(F.col("reason").isNull()).select(
        "subject_id", "pair_id",
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("compartment"), F.lit(m).alias("metric"),
                     _at(f"$.metrics.{c}.{m}").alias("leaf"))
            for c in COMPARTMENTS for m in metrics
        ])),
    )
    return leaves.select(
        "subject_id", "pair_id", "compartment", "metric",
        metric_value(F.col("leaf")).alias("value"),
        metric_status(F.col("leaf")).alias("status"),
        F.to_json("leaf").alias("raw"),
    )


def quality_metrics(parsed: DataFrame) -> DataFrame:
    """Dice and surface distance per (subject, compartment) under the looser coercion."""
    leaves = parsed.where(F.col("reason").isNull()).select(
        "subject_id",
        F.inline(F.array(*[
            F.struct(
                F.lit(c).alias("compartment"),
                quality_value(_at(f"$.metrics.{c}.dice")).alias("dice"),
                quality_value(_at(f"$.metrics.{c}.hd95_mm")).alias("hd95_mm"),
            )
            for c in COMPARTMENTS
        ])),
    )
    return leaves


def parse_run_records(documents: DataFrame, versions: Sequence[str] = SIDECAR_VERSIONS) -> DataFrame:
    """Run sidecars (subject_id, stage, value, mtime) to typed records plus ``reason``."""
    text = lambda path: F.try_variant_get("doc", path, "string")
    parsed = computed_once(documents, {"doc": F.try_parse_json("value")})
    elapsed = elapsed_seconds(_at("$.elapsed_s"))
    threads = F.when(variant_kind(_at("$.threads")) == "BIGINT",
                     F.try_variant_get("doc", "$.threads", "int"))
    reason = (
        F.when(F.col("value").isNull(), "sidecar not found")
        .when(F.col("doc").isNull() | (variant_kind(F.col("doc")) != "OBJECT"),
              "could not parse JSON")
        .when(~F.coalesce(text("$.schema_version"), F.lit("?")).isin(*versions),
              "schema_version not accepted")
        .when(elapsed.isNull(), "missing finite 'elapsed_s'")
    )
    return parsed.select(
        "subject_id", "stage", elapsed.alias("elapsed_s"),
        F.coalesce(text("$.backend"), F.lit("?")).alias("backend"),
        F.coalesce(
            text("$.device"),
            F.when(threads.isNotNull(), F.concat(F.lit("CPU/"), threads.cast("string"), F.lit("t"))),
            F.lit("CPU"),
        ).alias("device"),
        text("$.version").alias("version"), threads.alias("threads"), "mtime",
        reason.alias("reason"),
    )
