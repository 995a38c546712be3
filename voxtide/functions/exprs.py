"""Column expressions shared by the feature packs.  A value that can't be computed is null, never zero or NaN."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0 or null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def sd(c: Column | str, least: int = 2) -> Column:
    """Population standard deviation of at least ``least`` values."""
    return F.when(F.count(c) >= least, F.stddev_pop(c))


def quantile(c: Column | str, p: float) -> Column:
    """Exact, linearly interpolated."""
    return F.percentile(c, F.lit(p))


def iqr(c: Column | str) -> Column:
    return F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))


def cv(c: Column | str) -> Column:
    return F.when(F.avg(c) != 0, F.stddev_pop(c) / F.avg(c))


def skew(c: Column | str) -> Column:
    """Unbiased skewness of at least three values that differ."""
    n = F.count(c).cast("double")
    return F.when((F.count(c) >= 3) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def kurt(c: Column | str) -> Column:
    """Unbiased excess kurtosis of at least four values that differ."""
    n = F.count(c).cast("double")
    return F.when((F.count(c) >= 4) & (F.stddev_pop(c) > 0), ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / F.when(n > 3, (n - 2) * (n - 3)))


def seconds_to_ms(c: Column) -> Column:
    """Half to even, as Python rounds."""
    return F.bround(c * 1000, 0).cast("long")
