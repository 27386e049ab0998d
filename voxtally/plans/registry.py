"""Collects the queries: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]

RUNS: dict[str, Run] = {}
SQL: dict[str, str] = {}

DIGITS = 6


def query(name: str, sql: str | None = None, *, rounded: Sequence[str] = ()):
    """Register a query. Columns in ``rounded`` are compared at six decimals on both sides,
    because sums of doubles depend on the order of the rows."""

    def add(run: Run) -> Run:
        def call(spark: SparkSession, folder: str) -> DataFrame:
            out = run(spark, folder)
            return out.withColumns(
                {c: F.round(F.col(c), DIGITS) + F.lit(0.0) for c in rounded}
            ) if rounded else out

        call.__name__, call.__doc__ = run.__name__, run.__doc__
        if name in RUNS:
            raise ValueError(f"query {name!r} registered twice")
        RUNS[name] = call
        if sql is not None:
            changes = ", ".join(
                f"round({c}, {DIGITS}) + 0.0::DOUBLE AS {c}" for c in rounded
            )
            SQL[name] = f"SELECT * REPLACE ({changes}) FROM (\n{sql}\n)" if rounded else sql
        return run

    return add
