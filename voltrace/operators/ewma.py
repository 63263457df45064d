"""EWMA volatility in DataFrame functions: no Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrace.operators import scan


def _decay(decay: float) -> float:
    if not 0 < decay < 1:
        raise ValueError("decay lies between 0 and 1")
    return float(decay)


def forecast_variance(ordered: Column, decay: float = 0.94) -> Column:
    """From an array of returns in time order: v0 = r0^2, v = d v + (1 - d) r^2 over all returns, which gives the next step's variance."""
    d = _decay(decay)
    return F.aggregate(ordered, F.get(ordered, F.lit(0)) * F.get(ordered, F.lit(0)), lambda v, r: v * d + r * r * (1 - d))


def ordered_returns(time: str = "timestamp", value: str = "return") -> Column:
    """Aggregate: an array of a group's returns in time order. For groups with a bounded number of rows, such as training windows."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(time), F.col(value))))
    return F.transform(pairs, lambda p: p[value])


def calculate_ewma(returns: DataFrame, decay: float = 0.94, *, by=("asset_id",), time: str = "timestamp", value: str = "return") -> DataFrame:
    """(by..., ewma_variance, ewma_volatility, observations): the forecast after the last return of each group.

    The recursion's closed form, a sum weighted by the number of later returns: no group is held in one array.
    """
    d = _decay(decay)
    r2 = (F.col(value) * F.col(value)).alias("__r2")
    rows = scan.positions(returns.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(time).alias("__t"), r2), by, ["__t", "__r2"], "__position", "ewma")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))  # a row for each group
    rows = scan.matched(rows, sizes, by) if by else rows.crossJoin(F.broadcast(sizes))
    n, later = F.count(F.lit(1)), F.col("__n") - 1 - F.col("__position")
    v = F.pow(F.lit(d), n) * F.min_by("__r2", "__position") + (1 - d) * F.sum(F.pow(F.lit(d), later) * F.col("__r2"))
    return rows.groupBy(*by).agg(v.alias("ewma_variance"), F.sqrt(v).alias("ewma_volatility"), n.alias("observations"))


def transform(returns: DataFrame, decay: float = 0.94, *, by=("asset_id",), time: str = "timestamp", value: str = "return") -> DataFrame:
    """(by..., time, value, variance, volatility): the whole series, v0 = r0^2 and v = d v + (1 - d) r^2 of the row before.

    The recursion is solved by decayed sums over blocks of rows, so a group is dealt over many tasks and no Python runs.
    """
    d, names = _decay(decay), [*by, time, value]
    rows = scan.positions(returns.select(*names).filter(F.col(value).isNotNull()), by, [time, value], "__position", "ewma")
    first = rows.filter("__position = 0").select(*by, (F.col(value) * F.col(value)).alias("__first"))  # a row for each group
    sums = scan.decayed_sum(rows, F.col(value) * F.col(value), d, by, name="__sum", position="__position", exclusive=True)
    v = F.pow(F.lit(d), F.col("__position")) * F.col("__first") + (1 - d) * F.col("__sum")
    out = scan.matched(sums, first, by) if by else sums.crossJoin(F.broadcast(first))  # without groups, one row
    return out.withColumn("variance", v).select(*names, "variance", F.sqrt("variance").alias("volatility"))


def fit_transform(returns: DataFrame, decay: float = 0.94, **options) -> DataFrame:
    by = options.get("by", ("asset_id",))
    last = calculate_ewma(returns, decay, **options).select(*by, F.col("ewma_variance").alias("forecast_variance"), F.col("ewma_volatility").alias("forecast_volatility"))
    return transform(returns, decay, **options).join(last, list(by))
