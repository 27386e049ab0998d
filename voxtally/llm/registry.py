"""The queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]

RUNS: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Run) -> Run:
        if name in RUNS:
            raise ValueError(f"query {name!r} registered twice")
        RUNS[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add
