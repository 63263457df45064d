"""Streaming forms: hourly bars with a watermark, and EWMA with keyed state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(ticks: DataFrame, *, late: str = "1 hour", every: str = "1 hour") -> DataFrame:
    """Bars of a stream (ts, event_type, value, event_id); a bar is final once the watermark passes its end."""
    at = F.struct("ts", "event_id")
    t = ticks.select(F.col("ts").cast("timestamp").alias("ts"), F.upper(F.trim("event_type")).alias("asset_id"), "event_id", F.col("value").alias("price")).filter("price > 0")
    grouped = t.withWatermark("ts", late).groupBy(F.window("ts", every), "asset_id").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return grouped.select(F.col("window.start").alias("timestamp"), "asset_id", "open", "high", "low", "close", "volume")


def streaming_ewma(returns: DataFrame, decay: float = 0.94) -> DataFrame:
    """(asset_id, timestamp, variance) of a stream (asset_id, timestamp, return): the forecast after each row, the state carried from batch to batch."""

    def step(key, batches, state):
        n, v = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values("timestamp")
        out = []
        for r in rows["return"]:
            v = decay * (r * r if n == 0 else v) + (1 - decay) * r * r
            n += 1
            out.append(v)
        state.update((n, v))
        yield pd.DataFrame({"asset_id": key[0], "timestamp": rows["timestamp"], "variance": out})

    return returns.groupBy("asset_id").applyInPandasWithState(step, "asset_id string, timestamp timestamp, variance double", "n long, v double", "append", "NoTimeout")
