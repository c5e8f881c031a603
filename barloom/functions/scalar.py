"""Scalar expressions.  Warm-up and undefined values are null, never NaN, so comparisons are not true."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.config import SECONDS_PER_YEAR

EPS = 1e-12


def safe_div(a: Column, b: Column) -> Column:
    """Null where the divisor is 0, also under ANSI arithmetic."""
    return F.try_divide(a, b)


def clip(x: Column, low: float, high: float) -> Column:
    """Clamped to both sides; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def to_double(text: Column) -> Column:
    """A cell as a number; blank, nan, none, null and unparsable cells are null."""
    bare = F.trim(text)
    return F.when(F.lower(bare).isin("", "nan", "none", "null"), None).otherwise(bare.try_cast("double"))


def to_long(text: Column) -> Column:
    """Through a number, truncated toward zero."""
    x = to_double(text)
    return F.when(finite(x), x.try_cast("bigint"))


def annual_factor(bar_seconds: int) -> float:
    return SECONDS_PER_YEAR / max(1, int(bar_seconds))


def split_index(n: int, holdout_frac: float, always: bool = False) -> int:
    """First holdout bar of n; without ``always`` a fraction of 0 or less keeps every bar for training."""
    if holdout_frac <= 0 and not always:
        return n
    h = min(0.5, max(0.05, holdout_frac))
    return max(2, min(n - 2, round(n * (1 - h))))


def split_index_column(n: Column, holdout_frac: float) -> Column:
    if holdout_frac <= 0:
        return n.cast("bigint")
    h = min(0.5, max(0.05, holdout_frac))
    return F.greatest(F.lit(2), F.least(n - 2, F.bround(n * F.lit(1 - h)).cast("bigint")))
