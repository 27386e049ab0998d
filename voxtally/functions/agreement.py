"""Agreement statistics as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtally.constants import LOA_MULTIPLIER


def dice(n_pred: Column, n_ref: Column, n_both: Column) -> Column:
    return F.try_divide(2.0 * n_both, n_pred + n_ref)


def jaccard(n_pred: Column, n_ref: Column, n_both: Column) -> Column:
    return F.try_divide(n_both * 1.0, n_pred + n_ref - n_both)


def sensitivity(n_ref: Column, n_both: Column) -> Column:
    return F.try_divide(n_both * 1.0, n_ref)


def specificity(n_grid: Column, n_pred: Column, n_ref: Column, n_both: Column) -> Column:
    return F.try_divide((n_grid - n_pred - n_ref + n_both) * 1.0, n_grid - n_ref)


def volume_error(n_pred: Column, n_ref: Column, voxel_mm3: Column) -> Column:
    return (n_pred - n_ref) * voxel_mm3


def concordance(x: Column, y: Column) -> Column:
    """Concordance correlation over pairs where both sides are present."""
    both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    px, py = F.when(both, x), F.when(both, y)
    spread = F.var_pop(px) + F.var_pop(py) + F.pow(F.avg(px) - F.avg(py), F.lit(2.0))
    return F.when(F.count_if(both) >= 2, F.try_divide(2.0 * F.covar_pop(px, py), spread))


def limits_of_agreement(diff: Column) -> tuple[Column, Column, Column, Column]:
    """(mean, sample std, lower limit, upper limit); std and limits NULL for one pair."""
    mean, sd = F.avg(diff), F.stddev_samp(diff)
    return mean, sd, mean - LOA_MULTIPLIER * sd, mean + LOA_MULTIPLIER * sd
