"""Column functions that Spark SQL lacks: error function, normal and chi-square tails, clipping, NaN handling."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.when(b != 0, b)


def erfc(x: Column) -> Column:
    """Complementary error function: Maclaurin series below 2.5, continued fraction above. For rows of results, not of data."""
    z = F.abs(x)
    square = F.least(z, F.lit(2.5)) * F.least(z, F.lit(2.5))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))

    def step(acc: Column, n: Column) -> Column:
        term = acc["term"]
        return F.struct((term * -square / (n + 1)).alias("term"), (acc["sum"] + term / (2 * n + 1)).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(0), F.lit(60)), start, step)["sum"]
    small = 1 - F.lit(2 / math.sqrt(math.pi)) * F.least(z, F.lit(2.5)) * series
    wide = F.greatest(z, F.lit(2.5))
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), wide, lambda f, k: wide + (k / F.lit(2.0)) / f)
    large = F.exp(-wide * wide) / F.lit(math.sqrt(math.pi)) / fraction
    tail = F.when(z < 2.5, small).otherwise(large)
    return F.when(x < 0, 2 - tail).otherwise(tail)


def normal_cdf(x: Column) -> Column:
    return erfc(-x / F.lit(math.sqrt(2.0))) / 2


def chi2_sf_1(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return erfc(F.sqrt(F.greatest(x, F.lit(0.0)) / 2))


def chi2_sf_2(x: Column) -> Column:
    """Upper tail of chi-square with two degrees of freedom."""
    return F.exp(-F.greatest(x, F.lit(0.0)) / 2)


def xlogy(n: Column, p: Column) -> Column:
    """n * ln(p), 0 where n is 0, minus infinity where p is 0 and n is not."""
    return F.when(n == 0, F.lit(0.0)).when(p <= 0, F.lit(float("-inf"))).otherwise(n * F.log(F.when(p > 0, p)))
