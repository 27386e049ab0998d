"""Every query of this package."""

from __future__ import annotations

from voxtally.llm import copy_queries, filter_queries, manifest_queries, text_queries  # noqa: F401
from voxtally.llm.registry import RUNS, SQL, Run


def queries() -> dict[str, Run]:
    return dict(RUNS)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
