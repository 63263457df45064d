"""Realised variance and volatility, and the next-day target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log_return(order: str = "timestamp", *partition: str):
    """ln(close / previous close) within a partition; null at its start and where a price isn't positive."""
    w = Window.partitionBy(*(partition or ("asset_id",))).orderBy(order)
    close = F.when(F.col("close") > 0, F.col("close"))
    return F.log(close / F.lag(close).over(w))


def calculate_intraday_log_returns(bars: DataFrame) -> DataFrame:
    """(timestamp, asset_id, trading_date, log_return) within asset and day; the overnight step is no return."""
    days = bars.withColumn("trading_date", F.to_date("timestamp"))
    return days.withColumn("log_return", log_return("timestamp", "asset_id", "trading_date")).select("timestamp", "asset_id", "trading_date", "log_return")


def compute_realized_variance(bars: DataFrame) -> DataFrame:
    """(asset_id, trading_date, realized_variance, observation_count); days without a return vanish."""
    r = calculate_intraday_log_returns(bars).filter(F.col("log_return").isNotNull())
    return r.groupBy("asset_id", "trading_date").agg(F.sum(F.col("log_return") * F.col("log_return")).alias("realized_variance"), F.count(F.lit(1)).alias("observation_count"))


def compute_realized_volatility(bars: DataFrame) -> DataFrame:
    return compute_realized_variance(bars).select("asset_id", "trading_date", "realized_variance", F.sqrt("realized_variance").alias("realized_volatility"), "observation_count")


def panel_metadata(df: DataFrame, time: str) -> DataFrame:
    """One row: row_count, asset_count, start, end."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("asset_id").alias("asset_count"), F.min(time).alias("start"), F.max(time).alias("end"))


def build_realized_volatility_result(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    out = compute_realized_volatility(bars)
    return out, panel_metadata(out, "trading_date")


def create_next_day_target(rv: DataFrame) -> DataFrame:
    """(asset_id, trading_date, realized_volatility, target): the next row's volatility; the last row of an asset goes."""
    w = Window.partitionBy("asset_id").orderBy("trading_date")
    out = rv.select("asset_id", "trading_date", "realized_volatility").withColumn("target", F.lead("realized_volatility").over(w))
    return out.filter(F.col("target").isNotNull())


def build_target_result(rv: DataFrame) -> tuple[DataFrame, DataFrame]:
    out = create_next_day_target(rv)
    return out, panel_metadata(out, "trading_date")


def save_realized_volatility(bars: DataFrame, path: str) -> DataFrame:
    compute_realized_volatility(bars).write.mode("overwrite").parquet(path)
    return bars.sparkSession.read.parquet(path)


def save_target(rv: DataFrame, path: str) -> DataFrame:
    create_next_day_target(rv).write.mode("overwrite").parquet(path)
    return rv.sparkSession.read.parquet(path)


# Research dataset ---------------------------------------------------------------


def prepare_returns(bars: DataFrame) -> DataFrame:
    """Bars with ``return``, the log return per asset; first rows and non-positive closes go."""
    r = bars.filter(F.col("close") > 0)
    return r.withColumn("return", log_return()).filter(F.col("return").isNotNull())


def merge_realized_volatility(frame: DataFrame, bars: DataFrame) -> DataFrame:
    """Left many-to-one join of daily volatility."""
    rv = compute_realized_volatility(bars).select("asset_id", "trading_date", "realized_variance", "realized_volatility")
    return frame.withColumn("trading_date", F.to_date("timestamp")).join(rv, ["asset_id", "trading_date"], "left")


def prepare_target(frame: DataFrame) -> DataFrame:
    """Adds ``target``: the volatility of the asset's next day, on every row of a day."""
    daily = frame.groupBy("asset_id", "trading_date").agg(F.max_by("realized_volatility", "timestamp").alias("last"))
    target = daily.withColumn("target", F.lead("last").over(Window.partitionBy("asset_id").orderBy("trading_date"))).drop("last")
    return frame.join(target, ["asset_id", "trading_date"], "left")


def prepare_research_dataset(bars: DataFrame, *, lag_days: int = 0) -> DataFrame:
    """Returns, daily volatility and next-day target; rows without any of them go.

    lag_days = 1 gives each bar the volatility of the day before, so that a bar never sees later bars of its day.
    """
    frame = merge_realized_volatility(prepare_returns(bars), bars)
    frame = prepare_target(frame)
    if lag_days:
        daily = frame.groupBy("asset_id", "trading_date").agg(*(F.max(c).alias(c) for c in ("realized_variance", "realized_volatility")))
        w = Window.partitionBy("asset_id").orderBy("trading_date")
        lagged = daily.select("asset_id", "trading_date", *(F.lag(c, lag_days).over(w).alias(c) for c in ("realized_variance", "realized_volatility")))
        frame = frame.drop("realized_variance", "realized_volatility").join(lagged, ["asset_id", "trading_date"], "left")
    ok = F.lit(True)
    for c in ("return", "realized_volatility", "target"):
        ok &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return frame.filter(ok & (F.col("realized_volatility") >= 0) & (F.col("target") >= 0))
