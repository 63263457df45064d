"""Forecast metrics, Diebold-Mariano tests and loss matrices, as aggregates over (actual, forecast) columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrace.functions.special import normal_cdf

LOSSES, ALTERNATIVES = ("absolute", "squared", "qlike"), ("two_sided", "less", "greater")


class EvaluationError(ValueError):
    """An unknown loss, alternative or lag."""


def loss(actual: Column, forecast: Column, kind: str = "squared") -> Column:
    """Pointwise loss; QLIKE is null unless both are positive."""
    kind = {"mae": "absolute", "rmse": "squared"}.get(kind, kind)
    if kind == "absolute":
        return F.abs(actual - forecast)
    if kind == "squared":
        return (actual - forecast) * (actual - forecast)
    if kind == "qlike":
        ratio = F.when((actual > 0) & (forecast > 0), actual / F.when(forecast > 0, forecast))
        return ratio - F.log(ratio) - 1
    raise EvaluationError(f"unknown loss {kind}")


def mae(actual: Column, forecast: Column) -> Column:
    return F.avg(loss(actual, forecast, "absolute"))


def rmse(actual: Column, forecast: Column) -> Column:
    return F.sqrt(F.avg(loss(actual, forecast, "squared")))


def qlike(actual: Column, forecast: Column) -> Column:
    return F.avg(loss(actual, forecast, "qlike"))


calculate_mae, calculate_rmse, calculate_qlike = mae, rmse, qlike


def calculate_forecast_metrics(df: DataFrame, *, actual_column: str = "actual", forecast_column: str = "forecast", by=()) -> DataFrame:
    """One pass: observations, mae, rmse, qlike, and the pairs that QLIKE can't take (not positive)."""
    a, f = F.col(actual_column).cast("double"), F.col(forecast_column).cast("double")
    pair = df.filter(a.isNotNull() & f.isNotNull() & ~F.isnan(a) & ~F.isnan(f))
    return pair.groupBy(*by).agg(
        F.count(F.lit(1)).alias("observations"), mae(a, f).alias("mae"), rmse(a, f).alias("rmse"), qlike(a, f).alias("qlike"),
        F.count_if((a <= 0) | (f <= 0)).alias("qlike_violations"))


def evaluate_forecast_dataframe(df: DataFrame, *, actual_column: str = "actual", forecast_column: str = "forecast") -> DataFrame:
    return calculate_forecast_metrics(df, actual_column=actual_column, forecast_column=forecast_column)


def compare_forecasts(predictions: DataFrame, *, model_column: str = "model", actual_column: str = "actual", forecast_column: str = "forecast") -> DataFrame:
    return calculate_forecast_metrics(predictions, actual_column=actual_column, forecast_column=forecast_column, by=(model_column,))


def calculate_loss_difference(df: DataFrame, *, actual: str = "actual", forecast_a: str, forecast_b: str, kind: str = "squared") -> DataFrame:
    return df.withColumn("loss_difference", loss(F.col(actual), F.col(forecast_a), kind) - loss(F.col(actual), F.col(forecast_b), kind))


def resolve_lag(observations: int, lag: int | None) -> int:
    """floor(cube root of n) by default; at most n - 1."""
    if lag is None:
        root = round(observations ** (1 / 3))
        lag = root if root**3 <= observations else root - 1
    if lag < 0 or lag >= max(1, observations):
        raise EvaluationError("lag must be between 0 and n - 1")
    return lag


def long_run_variance(df: DataFrame, value: str, order, max_lag: int, *, by=(), weight: str = "bartlett") -> DataFrame:
    """(by..., n, mean, gamma0, lrv): Newey-West with autocovariances over the n - k pairs of lag k, at least 0.

    Lagged products come from one window per series; averages skip the pairs that don't exist.
    """
    w, total = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by)
    base = df.select(*by, *[c for c in order if isinstance(c, str)], F.col(value).alias("x")).withColumn("c", F.col("x") - F.avg("x").over(total))
    pairs = base.select(*by, "x", "c", *((F.col("c") * F.lag("c", k).over(w)).alias(f"p{k}") for k in range(1, max_lag + 1)))
    out = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.avg(F.col("c") * F.col("c")).alias("gamma0"), *(F.avg(f"p{k}").alias(f"g{k}") for k in range(1, max_lag + 1)))
    lrv = F.col("gamma0")
    for k in range(1, max_lag + 1):
        lrv = lrv + F.lit(2.0 * (1 - k / (max_lag + 1))) * F.coalesce(F.col(f"g{k}"), F.lit(0.0))
    return out.withColumn("lrv", F.greatest(lrv, F.lit(0.0))).drop(*(f"g{k}" for k in range(1, max_lag + 1)))


def normal_p_value(statistic: Column, alternative: str = "two_sided") -> Column:
    if alternative == "two_sided":
        return F.least(F.lit(1.0), 2 * normal_cdf(-F.abs(statistic)))
    if alternative == "less":
        return normal_cdf(statistic)
    if alternative == "greater":
        return normal_cdf(-statistic)
    raise EvaluationError(f"unknown alternative {alternative}")


def diebold_mariano_test(df: DataFrame, *, actual: str = "actual", forecast_a: str, forecast_b: str, order=("timestamp",), kind: str = "squared",
                         alternative: str = "two_sided", lag: int | None = None, by=()) -> DataFrame:
    """One row (of each group): observations, lag, mean_difference, long_run_variance, statistic, p_value.

    A zero variance gives statistic 0 for equal losses, otherwise an infinite one. With groups, the lag must be given.
    """
    if lag is None:
        if by:
            raise EvaluationError("give the lag for a grouped test")
        lag = resolve_lag(df.count(), None)
    d = calculate_loss_difference(df, actual=actual, forecast_a=forecast_a, forecast_b=forecast_b, kind=kind)
    out = long_run_variance(d, "loss_difference", list(order), lag, by=by)
    se = F.sqrt(F.col("lrv") / F.col("n"))
    mean = F.col("mean")
    stat = F.when(se > 0, mean / F.when(se > 0, se)).when(mean == 0, 0.0).otherwise(F.signum(mean) * float("inf"))
    return out.select(*by, F.col("n").alias("observations"), F.lit(lag).alias("lag"), mean.alias("mean_difference"), F.col("lrv").alias("long_run_variance"),
                      stat.alias("statistic"), normal_p_value(stat, alternative).alias("p_value"))


def build_loss_matrix(predictions: DataFrame, models, *, observation="timestamp", model_column: str = "model", actual_column: str = "actual", forecast_column: str = "forecast", kind: str = "qlike") -> DataFrame:
    """Wide: one row per observation, one column per model. Naming the models spares the pivot a pass."""
    keys = [observation] if isinstance(observation, str) else list(observation)
    return predictions.withColumn("__loss", loss(F.col(actual_column), F.col(forecast_column), kind)).groupBy(*keys).pivot(model_column, list(models)).agg(F.first("__loss"))


def pairwise_loss_statistics(predictions: DataFrame, *, observation: str = "timestamp", model_column: str = "model", actual_column: str = "actual", forecast_column: str = "forecast", kind: str = "squared") -> DataFrame:
    """(model_a, model_b, n, mean_difference, t) of pairs of models on shared observations: a self-join on the observation, so models squared rows each."""
    x = predictions.select(F.col(observation).alias("obs"), F.col(model_column).alias("m"), loss(F.col(actual_column), F.col(forecast_column), kind).alias("l"))
    a, b = x.select("obs", F.col("m").alias("model_a"), F.col("l").alias("la")), x.select("obs", F.col("m").alias("model_b"), F.col("l").alias("lb"))
    d = a.join(b, "obs").filter("model_a < model_b").withColumn("d", F.col("la") - F.col("lb"))
    out = d.groupBy("model_a", "model_b").agg(F.count("d").alias("n"), F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    return out.select("model_a", "model_b", "n", "mean_difference", F.when(se > 0, F.col("mean_difference") / F.when(se > 0, se)).alias("t"))


def default_bandwidth(n: int) -> int:
    return max(1, math.isqrt(n))
