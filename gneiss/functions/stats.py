"""Column expressions for the statistics that Spark lacks or defines otherwise.

All are aggregates of one pass; empty input gives 0 where the engine's contract
says so, and null elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(col: Column) -> Column:
    """A value as double; null where it does not parse or is NaN."""
    parsed = col.try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def is_missing(col: Column, trim: bool = False) -> Column:
    """Null or the empty string; with trim also white space alone."""
    text = col.cast("string")
    return col.isNull() | ((F.trim(text) if trim else text) == "")


def mean(col: Column) -> Column:
    return F.coalesce(F.avg(col), F.lit(0.0))


def variance(col: Column, sample: bool = True) -> Column:
    """Zero for fewer than two values."""
    return F.coalesce(F.when(F.count(col) > 1, F.var_samp(col) if sample else F.var_pop(col)), F.lit(0.0))


def stdev(col: Column, sample: bool = True) -> Column:
    return F.sqrt(variance(col, sample))


def skewness(col: Column) -> Column:
    """n / ((n-1)(n-2)) times the sum of cubed z-scores of the population deviation; 0 below three values."""
    n = F.count(col).cast("double")
    return F.when((n > 2) & (F.stddev_pop(col) > 0), n * n / ((n - 1) * (n - 2)) * F.skewness(col)).otherwise(0.0)


def kurtosis(col: Column) -> Column:
    """Sample excess kurtosis with population z-scores; 0 below four values."""
    n = F.count(col).cast("double")
    raw = F.kurtosis(col) + 3
    value = n * n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * raw - 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))
    return F.when((n > 3) & (F.stddev_pop(col) > 0), value).otherwise(0.0)


def quantile(col: Column, q: float) -> Column:
    """Exact, linear between the two nearest ranks."""
    return F.percentile(col, F.lit(q))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of the rows that have both; null where one of them does not vary."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def entropy(count: Column, total: Column) -> Column:
    """One value's share of the Shannon entropy in bits; sum it over the values."""
    p = count / total
    return -p * F.log2(p)


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
