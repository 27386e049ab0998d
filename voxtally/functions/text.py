"""Identifiers, region names and printed cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtally.constants import (
    BASELINE_ID_PATTERN,
    CORTICAL_STEMS,
    GROWN_SUBJECT_ID_PATTERN,
    METRIC_DECIMALS,
    SUBCORTICAL_NAMES,
    SUBJECT_ID_PATTERN,
)

_PREFIX = r"^(ctx-lh-|ctx-rh-|wm-lh-|wm-rh-|Left-|Right-)"


def zero_fill(text: Column, width: int = 4) -> Column:
    """Left-pad with zeros, leaving longer text alone."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def normalize_subject_id(raw: Column, *, strict: bool = True, grown: bool = False) -> Column:
    """Drop a leading ``sub-``, trim, and require four digits.

    ``grown`` takes more than four as well: counters of a cohort beyond 9,999 subjects, which
    ``zero_fill`` leaves as long as they are.
    """
    bare = F.trim(F.regexp_replace(raw, "^sub-", ""))
    bad = (
        F.raise_error(F.concat(F.lit("expected a four-digit subject id, got: "), raw))
        if strict
        else F.lit(None).cast("string")
    )
    pattern = GROWN_SUBJECT_ID_PATTERN if grown else SUBJECT_ID_PATTERN
    return F.when(bare.rlike(pattern), bare).otherwise(bad)


def subject_id_from_exam(raw: Column, pattern: str = BASELINE_ID_PATTERN) -> Column:
    """Exam id to zero-filled subject id; NULL when it is not a baseline exam."""
    bare = F.trim(raw)
    return F.when(bare.rlike(pattern), zero_fill(F.regexp_extract(bare, pattern, 1)))


def hemisphere(name: Column) -> Column:
    prefix = F.regexp_extract(F.trim(name), _PREFIX, 1)
    return F.when(prefix.isin("ctx-lh-", "wm-lh-", "Left-"), F.lit("L")).when(
        prefix.isin("ctx-rh-", "wm-rh-", "Right-"), F.lit("R")
    )


def stem(name: Column) -> Column:
    """Region name without its hemisphere prefix."""
    return F.regexp_replace(F.trim(name), _PREFIX, "")


def lobe(name: Column) -> Column:
    """Lobe of a region name; unmapped or missing names fall into ``other``."""
    bare = stem(name)
    out = None
    for group in (CORTICAL_STEMS, SUBCORTICAL_NAMES):
        for lobe_name, stems in group.items():
            hit = bare.isin(*stems)
            out = F.when(hit, F.lit(lobe_name)) if out is None else out.when(hit, F.lit(lobe_name))
    return out.otherwise(F.lit("other"))


def version_from_banner(banner: Column) -> Column:
    """First ``major.minor[.patch]`` token of a version banner, NULL if there is none."""
    return F.nullif(F.regexp_extract(banner, r"\b(\d+\.\d+(?:\.\d+)?)\b", 1), F.lit(""))


def fixed(value: Column, decimals: int) -> Column:
    """Fixed-point text; ties go to the even digit, as printing a double does."""
    text = F.format_string(f"%.{decimals}f", F.bround(value, decimals))
    big = F.lit(float("inf"))
    return F.when(value == big, F.lit("inf")).when(value == -big, F.lit("-inf")).otherwise(text)


def robust_cell(median: Column, q1: Column, q3: Column, n_used: Column, metric: Column) -> Column:
    """``median [q1, q3]`` at the metric's precision, ``--`` for an empty cell."""
    out = F.when((n_used == 0) | median.isNull(), F.lit("--"))
    for name, decimals in METRIC_DECIMALS.items():
        text = F.concat(
            fixed(median, decimals), F.lit(" ["), fixed(q1, decimals),
            F.lit(", "), fixed(q3, decimals), F.lit("]"),
        )
        out = out.when(metric == name, text)
    return out
