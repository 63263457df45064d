"""Rolling, lagged, cross-asset and GARCH features. Windows of one asset share a single sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltrace.operators.volatility import log_return, panel_metadata

WINDOWS, LAGS = (5, 10, 20), (1, 2, 3, 5, 10)


class FeatureError(ValueError):
    """Features can't be made from these rows."""


def _check(values, what: str) -> tuple[int, ...]:
    values = tuple(values)
    if not values or len(set(values)) != len(values) or any(not isinstance(v, int) or v < 1 for v in values):
        raise FeatureError(f"{what} must be distinct positive integers")
    return values


def create_rolling_features(bars: DataFrame, *, windows=WINDOWS) -> DataFrame:
    """rolling_volatility_w, rolling_volume_w, rolling_range_w, momentum_w; null until a window is full."""
    order = Window.partitionBy("asset_id").orderBy("timestamp")
    base = bars.withColumn("__r", log_return()).withColumn("__range", (F.col("high") - F.col("low")) / F.when(F.col("close") != 0, F.col("close")))
    made = {}
    for w in _check(windows, "windows"):
        frame = order.rowsBetween(1 - w, 0)

        def full(value, column, frame=frame, w=w):
            return F.when(F.count(column).over(frame) == w, value.over(frame))

        made[f"rolling_volatility_{w}"] = full(F.stddev_samp("__r"), "__r")
        made[f"rolling_volume_{w}"] = full(F.avg("volume"), "volume")
        made[f"rolling_range_{w}"] = full(F.avg("__range"), "__range")
        made[f"momentum_{w}"] = F.col("close") / F.when(F.lag("close", w).over(order) != 0, F.lag("close", w).over(order)) - 1
    return base.select("timestamp", "asset_id", *(c.alias(n) for n, c in made.items()))


def create_lagged_returns(bars: DataFrame, *, lags=LAGS) -> DataFrame:
    order = Window.partitionBy("asset_id").orderBy("timestamp")
    base = bars.withColumn("__r", log_return())
    return base.select("timestamp", "asset_id", *(F.lag("__r", k).over(order).alias(f"return_lag_{k}") for k in _check(lags, "lags")))


def create_lagged_volatility(frame: DataFrame, *, volatility_column: str = "realized_volatility", lags=LAGS) -> DataFrame:
    order = Window.partitionBy("asset_id").orderBy("timestamp")
    v = F.when(F.col(volatility_column) >= 0, F.col(volatility_column))
    return frame.select("timestamp", "asset_id", *(F.lag(v, k).over(order).alias(f"volatility_lag_{k}") for k in _check(lags, "lags")))


def create_lagged_features(frame: DataFrame, *, return_lags=LAGS, volatility_column: str | None = None, volatility_lags=LAGS) -> DataFrame:
    """Both sets in one projection over one window: no join."""
    order = Window.partitionBy("asset_id").orderBy("timestamp")
    base = frame.withColumn("__r", log_return())
    made = [F.lag("__r", k).over(order).alias(f"return_lag_{k}") for k in _check(return_lags, "lags")] if return_lags else []
    if volatility_column is not None:
        v = F.when(F.col(volatility_column) >= 0, F.col(volatility_column))
        made += [F.lag(v, k).over(order).alias(f"volatility_lag_{k}") for k in _check(volatility_lags, "lags")]
    if not made:
        raise FeatureError("no features asked for")
    return base.select("timestamp", "asset_id", *made)


def create_cross_asset_features(bars: DataFrame) -> DataFrame:
    """Mean return, population dispersion and mean absolute return of the other assets at a timestamp; null without others."""
    base = bars.select("timestamp", "asset_id", log_return().alias("r"))
    # Sums by timestamp are joined back, so that a timestamp with all assets is an aggregate and not one window task.
    sums = base.groupBy("timestamp").agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"), F.sum(F.abs("r")).alias("a"))
    own = F.coalesce("r", F.lit(0.0))
    n = F.col("n") - F.when(F.col("r").isNotNull(), 1).otherwise(0)
    n = F.when(n > 0, n)
    mean = (F.col("s") - own) / n
    return base.join(sums, "timestamp").select(
        "timestamp", "asset_id", mean.alias("cross_asset_mean_return"),
        F.when(n.isNotNull(), F.sqrt(F.greatest((F.col("q") - own * own) / n - mean * mean, F.lit(0.0)))).alias("cross_asset_return_dispersion"),
        ((F.col("a") - F.abs(own)) / n).alias("cross_asset_mean_abs_return"))


def create_garch_features(frame: DataFrame) -> DataFrame:
    """(timestamp, asset_id, garch_forecast), checked: keys unique, forecasts finite and not negative."""
    out = frame.select("timestamp", F.upper(F.trim("asset_id")).alias("asset_id"), F.expr("try_cast(garch_forecast AS double)").alias("garch_forecast"))
    bad = F.col("garch_forecast").isNull() | F.isnan("garch_forecast") | (F.abs("garch_forecast") == float("inf")) | (F.col("garch_forecast") < 0)
    row = out.groupBy("timestamp", "asset_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")).agg(F.count_if(F.col("n") > 1).alias("copies"), F.sum("bad").alias("bad")).first()
    if row.copies or row.bad:
        raise FeatureError(f"{row.copies} repeated keys, {row.bad} invalid forecasts")
    return out


def uncovered(frame: DataFrame, features: DataFrame) -> DataFrame:
    """Rows of frame without a feature row."""
    return frame.join(features, ["timestamp", "asset_id"], "left_anti")


def merge_garch_features(frame: DataFrame, features: DataFrame) -> DataFrame:
    """One-to-one left join; fails if a row of frame has no forecast."""
    features = create_garch_features(features)
    missing = uncovered(frame, features).count()
    if missing:
        raise FeatureError(f"{missing} rows without a forecast")
    return frame.join(features, ["timestamp", "asset_id"], "left")


def feature_result(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features and their one-row metadata (rows, assets, range, feature names)."""
    names = [c for c in features.columns if c not in ("timestamp", "asset_id")]
    if not names:
        raise FeatureError("no features")
    return features, panel_metadata(features, "timestamp").withColumn("feature_columns", F.array(*map(F.lit, names)))


def build_rolling_feature_result(bars, *, windows=WINDOWS):
    return feature_result(create_rolling_features(bars, windows=windows))


def build_lagged_feature_result(frame, **options):
    return feature_result(create_lagged_features(frame, **options))


def build_cross_asset_feature_result(bars):
    return feature_result(create_cross_asset_features(bars))


def build_garch_feature_result(frame):
    return feature_result(create_garch_features(frame))
