"""OHLCV bars from tick-like tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrace.sources.contract import CANONICAL


def bars(ticks: DataFrame, asset: Column, ts: Column, price: Column, volume: Column | None = None, *, every: str = "hour", tie: Column | None = None) -> DataFrame:
    """Canonical bars of one aggregation (partial before the shuffle). Ticks without a positive price are left out."""
    t = ticks.select(
        F.upper(F.trim(asset.cast("string"))).alias("asset_id"), ts.cast("timestamp").alias("ts"), price.cast("double").alias("price"),
        (F.lit(1.0) if volume is None else volume.cast("double")).alias("v"), (F.lit(0) if tie is None else tie).alias("tie")).filter("price > 0")
    at = F.struct("ts", "tie")
    grouped = t.groupBy(F.date_trunc(every, "ts").alias("timestamp"), "asset_id").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("v").alias("volume"))
    return grouped.select(*CANONICAL.fieldNames())


def hourly_bars(events: DataFrame) -> DataFrame:
    """Bars of the events table, one asset for each event type."""
    return bars(events, F.col("event_type"), F.col("ts"), F.col("value"), tie=F.col("event_id"))


def daily_bars(lineitem: DataFrame, every: str = "day") -> DataFrame:
    """Bars of the lineitem table, one asset for each return flag, at unit prices."""
    return bars(lineitem, F.col("l_returnflag"), F.col("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"),
                every=every, tie=F.struct("l_orderkey", "l_linenumber"))
