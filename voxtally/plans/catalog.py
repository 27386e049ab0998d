"""Every registered query, in the order the modules define them."""

from __future__ import annotations

from voxtally.plans import (  # noqa: F401
    agreement_queries,
    cohort_queries,
    geometry_queries,
    intensity_queries,
    inventory_queries,
    longitudinal_queries,
    region_queries,
    robust_queries,
    rollup_queries,
    source_queries,
)
from voxtally.plans.registry import RUNS, SQL, Run


def queries() -> dict[str, Run]:
    return dict(RUNS)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
