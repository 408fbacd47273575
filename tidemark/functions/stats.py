"""Small statistical and binning expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .nulls import ColumnLike, _c

# Half of the 95% point of chi-square with one degree of freedom (fixed value).
PROFILE_CUT = 1.920729

# Standard normal multiplier of a 95% interval (fixed value).
Z95 = 1.96
# Standard normal multiplier of a 90% interval (fixed value).
Z90 = 1.645

# Length bins: lower edges from 6 to 70 cm in steps of 2 (fixed values).
LENGTH_LOW, LENGTH_HIGH, LENGTH_STEP = 6, 70, 2
# Age bins 1 to 29, the last one a plus group (fixed values).
AGE_LOW, AGE_PLUS = 1, 29
# Class breaks of the catch-rate map (fixed values).
CPUE_BREAKS = (0, 500, 2000, 5000, 7500, 16000)


def cv(variance: ColumnLike, mean: ColumnLike) -> Column:
    """Coefficient of variation; null when the mean is zero."""
    return F.try_divide(F.sqrt(_c(variance)), _c(mean))


def log_se(cv_col: ColumnLike) -> Column:
    """Standard error on the log scale that belongs to a CV."""
    c = _c(cv_col)
    return F.sqrt(F.log1p(c * c))


def limits(value: ColumnLike, cv_col: ColumnLike, k: float = 1.0) -> tuple[Column, Column]:
    """value -/+ k standard errors, the error being cv * value."""
    v, c = _c(value), _c(cv_col)
    return v - F.lit(float(k)) * c * v, v + F.lit(float(k)) * c * v


def aic(nll: ColumnLike, k: ColumnLike) -> Column:
    return F.lit(2.0) * _c(nll) + F.lit(2.0) * _c(k)


def aicc(nll: ColumnLike, k: ColumnLike, n: ColumnLike) -> Column:
    """Small-sample AIC; null when n - k - 1 is zero."""
    k, n = _c(k), _c(n)
    return aic(nll, k) + F.try_divide(F.lit(2.0) * k * (k + 1), n - k - 1)


def even_steps(low: float, high: float, count: int) -> Column:
    """Array of `count` equally spaced values from low to high."""
    width = (high - low) / (count - 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.lit(float(low)) + i.cast("double") * F.lit(width)
    )


def log_steps(low: float, high: float, count: int) -> Column:
    """Natural log of equally spaced values."""
    return F.transform(even_steps(low, high, count), lambda v: F.log(v))


def length_bin(
    x: ColumnLike, low: int = LENGTH_LOW, high: int = LENGTH_HIGH, step: int = LENGTH_STEP
) -> Column:
    """Lower edge of the length bin; values outside go to the end bins."""
    edge = F.floor(_c(x) / F.lit(step)) * F.lit(step)
    return F.when(_c(x).isNotNull(), F.least(F.greatest(edge, F.lit(low)), F.lit(high)).cast("int"))


def age_bin(x: ColumnLike, low: int = AGE_LOW, plus: int = AGE_PLUS) -> Column:
    """Age clamped to the first bin and the plus group."""
    return F.when(_c(x).isNotNull(), F.least(F.greatest(_c(x), F.lit(low)), F.lit(plus)).cast("int"))


def class_of(x: ColumnLike, breaks=CPUE_BREAKS) -> Column:
    """Index of the half-open class (lower, upper]; 0 below, len(breaks) above."""
    x = _c(x)
    out = F.when(x.isNull(), F.lit(None))
    for i, edge in enumerate(breaks):
        out = out.when(x <= F.lit(edge), F.lit(i))
    return out.otherwise(F.lit(len(breaks))).cast("int")


def length_bins(low: int = LENGTH_LOW, high: int = LENGTH_HIGH, step: int = LENGTH_STEP) -> list[int]:
    return list(range(low, high + 1, step))


def age_bins(low: int = AGE_LOW, plus: int = AGE_PLUS) -> list[int]:
    return list(range(low, plus + 1))


def normal_log_density_constant() -> float:
    return 0.5 * math.log(2.0 * math.pi)
