"""Quality checks on paired metrics: outlier flags, their reasons and reconciliation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.constants import COMPARTMENTS, DICE_FLOOR, HD95_CEILING_MM
from voxtally.functions.text import fixed


def wide_metrics(quality: DataFrame) -> DataFrame:
    """One row per subject: ``WT_dice`` .. ``ET_hd95_mm``."""
    return quality.groupBy("subject_id").agg(*[
        F.max(F.when(F.col("compartment") == c, F.col(m))).alias(f"{c}_{m}")
        for m in ("dice", "hd95_mm") for c in COMPARTMENTS
    ])


def flag_outliers(
    quality: DataFrame,
    *,
    floors: Mapping[str, float] = DICE_FLOOR,
    ceiling_mm: float = HD95_CEILING_MM,
) -> DataFrame:
    """Wide metrics with ``flagged`` and ``reasons``: too low, too far, infinite or missing."""
    reasons = []
    for c in COMPARTMENTS:
        dice, hd = F.col(f"{c}_dice"), F.col(f"{c}_hd95_mm")
        reasons.append(
            F.when(dice.isNull(), F.lit(f"{c}_dice_nan")).when(
                dice < floors[c],
                F.concat(F.lit(f"{c}_dice_lt_{floors[c]:.2f}("), fixed(dice, 3), F.lit(")")))
        )
        reasons.append(
            F.when(hd.isNull(), F.lit(f"{c}_hd95_nan"))
            .when(F.abs(hd) == float("inf"), F.lit(f"{c}_hd95_inf"))
            .when(hd > ceiling_mm,
                  F.concat(F.lit(f"{c}_hd95_gt_{ceiling_mm:.0f}mm("), fixed(hd, 1), F.lit(")")))
        )
    found = F.array_compact(F.array(*reasons))
    return wide_metrics(quality).withColumns({
        "flagged": F.size(found) > 0,
        "reasons": F.array_join(found, "; "),
    })


def adjudication_gaps(flagged: DataFrame, keep: DataFrame, exclude: DataFrame) -> DataFrame:
    """Subjects in both decision lists, and flagged subjects in neither."""
    ids = lambda df: df.select("subject_id")
    overlap = ids(keep).intersect(ids(exclude)).withColumn("issue", F.lit("keep and exclude"))
    open_cases = (
        ids(flagged.where("flagged"))
        .join(ids(keep), "subject_id", "left_anti")
        .join(ids(exclude), "subject_id", "left_anti")
        .withColumn("issue", F.lit("not adjudicated"))
    )
    return overlap.unionByName(open_cases)
