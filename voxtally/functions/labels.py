"""Label algebra: compartment masks, remaps, and conversions between label schemes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtally.constants import (
    COMPARATOR_COMPARTMENTS,
    COMPARATOR_REMAP,
    COMPARTMENT_CODES,
    ED,
    ET,
    INNER_ED_CODES,
    INNER_ET_CODES,
    INNER_NCR_CODES,
    NCR,
    WHOLE_TUMOR_CODE,
)


def in_compartment(label: Column, compartment: str) -> Column:
    """True where ``label`` belongs to the nested compartment."""
    return label.isin(*COMPARTMENT_CODES[compartment])


def label_from_probabilities(tc: Column, wt: Column, et: Column, threshold: float = 0.5) -> Column:
    """Hard label from three channel probabilities; the innermost hit wins."""
    return (
        F.when(et > threshold, F.lit(ET))
        .when(tc > threshold, F.lit(NCR))
        .when(wt > threshold, F.lit(ED))
        .otherwise(F.lit(0))
    )


def remap(label: Column, table: dict[int, int]) -> Column:
    """Recode ``label`` through a fixed table; codes it lacks become background."""
    out = None
    for code, target in table.items():
        hit = label == F.lit(code)
        out = F.when(hit, F.lit(target)) if out is None else out.when(hit, F.lit(target))
    return out.otherwise(F.lit(0))


def comparator_label(label: Column, kind: str) -> Column:
    if kind not in COMPARATOR_REMAP:
        raise ValueError(f"no remap for comparator {kind!r}")
    return remap(label, COMPARATOR_REMAP[kind])


def comparator_in_compartment(label: Column, kind: str, compartment: str) -> Column | None:
    """Mask of a comparator's own codes, or None when it does not resolve the compartment."""
    codes = COMPARATOR_COMPARTMENTS.get(kind, {}).get(compartment)
    return None if codes is None else label.isin(*codes)


def two_stage_label(
    whole: Column,
    inner: Column,
    *,
    whole_code: int = WHOLE_TUMOR_CODE,
    ncr: Iterable[int] = INNER_NCR_CODES,
    ed: Iterable[int] = INNER_ED_CODES,
    et: Iterable[int] = INNER_ET_CODES,
) -> Column:
    """Join a whole-tumor map and an inner map into one label scheme."""
    inside = whole == F.lit(whole_code)
    return (
        F.when(~inside | inside.isNull(), F.lit(0))
        .when(inner.isin(*et), F.lit(ET))
        .when(inner.isin(*ed), F.lit(ED))
        .when(inner.isin(*ncr), F.lit(NCR))
        .otherwise(F.lit(ED))
    )


def disjoint_volumes(wt: Column, tc: Column, et: Column) -> dict[str, Column]:
    """Nested volumes turned into disjoint ones, never below zero."""
    zero = F.lit(0.0)
    return {
        "NCR": F.greatest(tc - et, zero),
        "ED": F.greatest(wt - tc, zero),
        "ET": et,
    }
