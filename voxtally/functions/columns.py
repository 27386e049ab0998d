"""Control over where an expression is evaluated and which side of a join moves."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that are evaluated once per row, however often they are used later.

    Neighbouring projections are merged, which copies a costly expression (a JSON parse)
    into each of its uses. The output of a generator is never merged, so one is used here.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))


def by_shuffle(voxels: DataFrame) -> DataFrame:
    """One side of a join that must not be sent whole to every executor.

    A table expanded from few rows looks to the planner about as small as those rows, so it
    would broadcast it through the driver. The mark holds for the next join only.
    """
    return voxels.hint("merge")
