"""From documents to a training mix: quality, lines, near copies, benchmark leaks, weights.

Each stage takes and returns whole tables; ``run`` writes each stage's result to the shared
folder and reads it back, so an executor lost later costs one stage at most. A stage first
deletes the intermediate tables of the one before it, whose result stands written by then.

Further columns of the documents ride along under other names while a stage works, so none
clashes with an operator's own; one named ``copy`` gives way to the mix's number. Null ids
and texts are those of the operators; empty tables give an empty mix.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm import leaks, line_dedup, mixing, near_dedup, quality
from voxtally.llm.common import WORD, table
from voxtally.session import cut_lineage, drop_folders, folders_made, folders_since

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")

_left: list[str] = []


def stage(work: Stage) -> Stage:
    """Frees what the stage before left, unless ``docs`` still reads it (a result not written),
    and hides further columns from the stage's operator."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _left else []
        # A folder's name is unique, however the file system spells its path.
        if not any(folder.rsplit("/", 1)[-1] in file for folder in _left for file in read):
            drop_folders(spark, _left)
        mark = folders_made()
        hidden = {c: f"__further_{i}" for i, c in enumerate(docs.columns) if c not in DOCUMENT}
        out = work(spark, docs.withColumnsRenamed(hidden), sf_dir)
        taken = [name for c, name in hidden.items() if c in out.columns]
        out = out.drop(*taken).withColumnsRenamed({name: c for c, name in hidden.items() if name not in taken})
        _left[:] = folders_since(mark)
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or whose host does, go."""
    judged = quality.judge(cut_lineage(quality.rule_stats(docs)))
    return judged.where("kept").select(*docs.columns)


@stage
def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stood in an earlier document go. A document that loses every word, a
    whole copy, goes with them; ``n_chars`` follows the text."""
    cleaned = line_dedup.clean(docs)
    whole = (F.col("n_removed") == 0) | F.col("text").rlike(WORD)
    return cleaned.where(whole).withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    ).select(*docs.columns)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return near_dedup.one_of_each(docs).select(*docs.columns)


@stage
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


@stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; ``copy`` numbers its copies."""
    return mixing.emit(mixing.mix(docs)).select(*docs.columns, "copy")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("near copies", near_copies),
    ("benchmark leaks", benchmark_leaks),
    ("source mix", source_mix),
]

# Near-copy search and the retrieval of leaks are no SQL; tests hold the stages against
# brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
