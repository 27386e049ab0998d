"""Missing and infinite numbers: one place for every coercion rule.

Missing is NULL everywhere and infinity is a DOUBLE; NaN never leaves these functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INFINITY = ("inf", "-inf", "+inf")


def finite(value: Column) -> Column:
    """NULL for NaN and for infinities."""
    big = F.lit(float("inf"))
    return F.when(~F.isnan(value) & (F.abs(value) < big), value)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def variant_kind(v: Column) -> Column:
    """Type of a VARIANT leaf; VOID for JSON null, NULL for an absent path."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def is_number(v: Column) -> Column:
    return variant_kind(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def variant_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def variant_double(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def metric_status(v: Column) -> Column:
    """``ok``, ``missing`` or ``inf`` for one raw metric leaf."""
    text = F.lower(variant_text(v))
    number = variant_double(v)
    return (
        F.when(
            is_number(v),
            F.when(F.isnan(number), "missing")
            .when(F.abs(number) == F.lit(float("inf")), "inf")
            .otherwise("ok"),
        )
        # The bare spelling counts only in lower case; signed spellings in any case.
        .when((variant_kind(v) == "STRING") & (variant_text(v) == "inf"), "inf")
        .when((variant_kind(v) == "STRING") & text.isin("-inf", "+inf"), "inf")
        .otherwise("missing")
    )


def metric_value(v: Column) -> Column:
    """The number behind an ``ok`` leaf; Infinity for ``inf``; NULL for ``missing``."""
    status = metric_status(v)
    return F.when(status == "ok", variant_double(v)).when(
        status == "inf", F.lit(float("inf"))
    )


def quality_value(v: Column) -> Column:
    """Looser coercion for quality checks: numeric text counts, bad text is missing."""
    text = variant_text(v)
    parsed = nan_to_null(F.trim(text).try_cast("double"))
    boolean = F.when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0))
    return (
        F.when(variant_kind(v) == "STRING",
               F.when(F.lower(text) == "inf", F.lit(float("inf"))).otherwise(parsed))
        .when(variant_kind(v) == "BOOLEAN", boolean)
        .when(is_number(v), nan_to_null(variant_double(v)))
    )


def elapsed_seconds(v: Column) -> Column:
    """A finite, non-negative JSON number; NULL for anything else."""
    number = finite(variant_double(v))
    return F.when(is_number(v) & (number >= 0), number)


def json_number(value: Column, *, infinity: str | None = "inf") -> Column:
    """JSON text of a double: NULL -> null, infinity -> quoted word or null."""
    inf_text = F.lit("null") if infinity is None else F.lit(f'"{infinity}"')
    return (
        F.when(value.isNull() | F.isnan(value), F.lit("null"))
        .when(F.abs(value) == F.lit(float("inf")), inf_text)
        .otherwise(F.to_json(F.struct(value.alias("v"))).substr(F.lit(6), F.length(
            F.to_json(F.struct(value.alias("v")))) - 6))
    )


def voxel_volume_mm3(affine: Column) -> Column:
    """|det| of the upper-left 3x3 block of a row-major 4x4 affine."""
    a = [[affine.getItem(i).getItem(j) for j in range(3)] for i in range(3)]
    return F.abs(
        a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1])
        - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0])
        + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])
    )


def voxel_spacing_mm(affine: Column) -> list[Column]:
    """Column norms of the affine's 3x3 block."""
    cell = lambda i, j: affine.getItem(i).getItem(j)
    return [
        F.sqrt(cell(0, j) * cell(0, j) + cell(1, j) * cell(1, j) + cell(2, j) * cell(2, j))
        for j in range(3)
    ]
