"""Numeric expressions with the missing-value rules of the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column, scale: float = 1.0) -> Column:
    """``top / bottom * scale``, 0 when the divisor is 0."""
    return F.coalesce(F.try_divide(top.cast("double") * scale, bottom.cast("double")), F.lit(0.0))


def skew(value: Column) -> Column:
    """Bias-corrected skewness: null below three values, 0 for a constant."""
    n = F.count(value).cast("double")
    g1 = F.when(F.min(value) == F.max(value), 0.0).otherwise(F.skewness(value))
    return F.when(n >= 3, F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2))


def kurt(value: Column) -> Column:
    """Bias-corrected excess kurtosis: null below four values, 0 for a constant."""
    n = F.count(value).cast("double")
    spread = F.try_divide((n - 1) * ((n + 1) * F.kurtosis(value) + 6), (n - 2) * (n - 3))
    return F.when(n >= 4, F.when(F.min(value) == F.max(value), 0.0).otherwise(spread))


def std(value: Column) -> Column:
    """Sample standard deviation, null below two values."""
    return F.when(F.count(value) > 1, F.stddev_samp(value))

