"""Stress scenarios: selection, metrics and analysis. A scenario set is one long table with a ``scenario`` column."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltrace.operators.portfolio import wealth_columns
from voltrace.operators.quantiles import exact_quantiles
from voltrace.runtime import materialize

METRICS = ("total_return", "mean_return", "volatility", "downside_deviation", "max_drawdown", "cumulative_return")
TIME = ("timestamp", "asset_id")


class StressError(ValueError):
    """Invalid percentiles, windows or scenario names."""


def _percentile(df: DataFrame, *percents: float) -> DataFrame:
    if any(not 0 <= p <= 100 for p in percents):
        raise StressError("percentiles lie between 0 and 100")
    return exact_quantiles(df, "volatility", [p / 100 for p in percents]).select("q")


def identify_normal_volatility(df: DataFrame, *, lower_percentile: float = 0.0, upper_percentile: float = 50.0, cuts: DataFrame | None = None) -> DataFrame:
    """cuts: one row with an array q of both percentiles, where they are known already."""
    if lower_percentile >= upper_percentile:
        raise StressError("the lower percentile must be the smaller one")
    q = _percentile(df, lower_percentile, upper_percentile) if cuts is None else cuts
    return df.crossJoin(F.broadcast(q)).filter(F.col("volatility").between(F.col("q")[0], F.col("q")[1])).drop("q")  # q: one row


def identify_high_volatility(df: DataFrame, *, percentile: float = 90.0, cuts: DataFrame | None = None) -> DataFrame:
    q = _percentile(df, percentile) if cuts is None else cuts
    return df.crossJoin(F.broadcast(q)).filter(F.col("volatility") >= F.col("q")[0]).drop("q")  # q: one row


def identify_volatility_spikes(df: DataFrame, *, percentile: float = 99.0, cuts: DataFrame | None = None) -> DataFrame:
    return identify_high_volatility(df, percentile=percentile, cuts=cuts)


def identify_prolonged_drawdowns(df: DataFrame, *, minimum_drawdown: float = -0.1, minimum_duration: int = 5, from_one: bool = False) -> DataFrame:
    """Rows of runs, within an asset, of at least minimum_duration rows at or below minimum_drawdown; adds drawdown, run and duration."""
    if minimum_drawdown >= 0 or minimum_duration < 1:
        raise StressError("a drawdown is negative and lasts at least one row")
    order = Window.partitionBy("asset_id").orderBy("timestamp")
    walk = wealth_columns(df, "return", ("timestamp",), ("asset_id",), from_one=from_one).withColumn("__deep", F.col("drawdown") <= minimum_drawdown)
    starts = (F.col("__deep") != F.coalesce(F.lag("__deep").over(order), ~F.col("__deep"))).cast("int")
    runs = walk.withColumn("__start", starts).withColumn("run", F.sum("__start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # The run's id is kept next to the asset, so counting it needs no further shuffle than by asset.
    counted = runs.withColumn("duration", F.count(F.lit(1)).over(Window.partitionBy("asset_id", "run")))
    return counted.filter(F.col("__deep") & (F.col("duration") >= minimum_duration)).drop("__deep", "__start", "wealth", "peak")


def identify_regime_transitions(df: DataFrame, *, regime_column: str = "regime") -> DataFrame:
    """Rows whose regime isn't the one before it, of the same asset; adds previous_regime."""
    before = F.lag(regime_column).over(Window.partitionBy("asset_id").orderBy("timestamp"))
    return df.withColumn("previous_regime", before).filter(F.col("previous_regime").isNotNull() & (F.col(regime_column) != F.col("previous_regime")))


def select_historical_window(df: DataFrame, *, start_date: str, end_date: str) -> DataFrame:
    if str(start_date) > str(end_date):
        raise StressError("a window starts before it ends")
    return df.filter(F.to_date("timestamp").between(F.lit(start_date).cast("date"), F.lit(end_date).cast("date")))


def build_stress_scenarios(df: DataFrame, *, normal_lower_percentile: float = 0.0, normal_upper_percentile: float = 50.0, high_volatility_percentile: float = 90.0,
                           volatility_spike_percentile: float = 99.0, minimum_drawdown: float = -0.1, minimum_drawdown_duration: int = 5,
                           regime_column: str | None = None, historical_windows: Iterable[tuple[str, str, str]] = ()) -> DataFrame:
    """(scenario, timestamp, asset_id, return, volatility): the union of all scenarios, historical windows by their names."""
    keep = ("timestamp", "asset_id", "return", "volatility")
    q = materialize(_percentile(df, normal_lower_percentile, normal_upper_percentile, high_volatility_percentile, volatility_spike_percentile), "stress-cuts")  # all of them from one selection
    normal, high, spike = (q.select(F.slice("q", *at).alias("q")) for at in ((1, 2), (3, 1), (4, 1)))
    parts = {
        "normal_volatility": identify_normal_volatility(df, lower_percentile=normal_lower_percentile, upper_percentile=normal_upper_percentile, cuts=normal),
        "high_volatility": identify_high_volatility(df, percentile=high_volatility_percentile, cuts=high),
        "volatility_spikes": identify_volatility_spikes(df, percentile=volatility_spike_percentile, cuts=spike),
        "prolonged_drawdowns": identify_prolonged_drawdowns(df, minimum_drawdown=minimum_drawdown, minimum_duration=minimum_drawdown_duration),
    }
    if regime_column is not None:
        parts["regime_transitions"] = identify_regime_transitions(df, regime_column=regime_column)
    for name, start, end in historical_windows:
        if name in parts:
            raise StressError(f"scenario {name} is there twice")
        parts[name] = select_historical_window(df, start_date=start, end_date=end)
    out = None
    for name, part in parts.items():
        rows = part.select(F.lit(name).alias("scenario"), *keep)
        out = rows if out is None else out.unionByName(rows)
    return out


def scenario_names(spark, names: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "scenario string")


def summarize_scenarios(scenarios: DataFrame, names: DataFrame) -> DataFrame:
    """(scenario, observation_count, asset_count, start, end); scenarios without rows have 0 and nulls."""
    got = scenarios.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("asset_id").alias("assets"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))
    return names.join(got, "scenario", "left").select("scenario", F.coalesce("n", F.lit(0)).alias("observation_count"), F.coalesce("assets", F.lit(0)).alias("asset_count"), "start", "end")


def run_stress_scenarios(scenarios: DataFrame, names: DataFrame | None = None, *, from_one: bool = False) -> DataFrame:
    """Metrics of each scenario over its rows in the order (timestamp, asset_id); scenarios without rows have count 0 and null metrics."""
    walk = wealth_columns(scenarios, "return", TIME, ("scenario",), from_one=from_one)
    r, year = F.col("return"), math.sqrt(252)
    down = F.least(r, F.lit(0.0))
    out = walk.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("observation_count"), F.count_distinct("asset_id").alias("asset_count"), F.sum(r).alias("total_return"), F.avg(r).alias("mean_return"),
        (F.coalesce(F.stddev_samp(r), F.lit(0.0)) * year).alias("volatility"), (F.sqrt(F.avg(down * down)) * year).alias("downside_deviation"),
        F.min("drawdown").alias("max_drawdown"), (F.product(1 + r) - 1).alias("cumulative_return"))
    if names is None:
        return out
    return names.join(out, "scenario", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("observation_count", "asset_count")})


def run_stress_scenario(df: DataFrame, *, scenario_name: str, from_one: bool = False) -> DataFrame:
    return run_stress_scenarios(df.withColumn("scenario", F.lit(scenario_name)), scenario_names(df.sparkSession, [scenario_name]), from_one=from_one)


def compare_stress_scenarios(results: DataFrame) -> DataFrame:
    return results


summarize_stress_analysis = compare_stress_scenarios


def analyze_stress_results(results: DataFrame) -> DataFrame:
    """Adds *_change_vs_mean, against the mean of scenarios with rows. Results are one row per scenario."""
    mean = results.filter("observation_count > 0").agg(*(F.avg(m).alias(f"mean_{m}") for m in METRICS))
    out = results.crossJoin(F.broadcast(mean))  # one row
    return out.select(*results.columns, *((F.col(m) - F.col(f"mean_{m}")).alias(f"{m}_change_vs_mean") for m in METRICS))


def calculate_stress_changes(results: DataFrame, *, reference_scenario: str) -> DataFrame:
    """Adds *_change against the one row of the reference scenario."""
    ref = results.filter(F.col("scenario") == reference_scenario)
    if ref.count() != 1:
        raise StressError(f"{reference_scenario} must have exactly one row")
    ref = ref.select(*(F.col(m).alias(f"reference_{m}") for m in METRICS))
    return results.crossJoin(F.broadcast(ref)).select(*results.columns, *((F.col(m) - F.col(f"reference_{m}")).alias(f"{m}_change") for m in METRICS))


def build_stress_analysis_table(results: DataFrame) -> DataFrame:
    has, cum = F.col("observation_count") > 0, F.abs("cumulative_return")
    return results.withColumns({
        "has_observations": has,
        "return_per_observation": F.when(has, F.col("total_return") / F.when(has, F.col("observation_count"))),
        "drawdown_magnitude": F.abs("max_drawdown"),
        "volatility_to_return": F.when(cum > 0, F.col("volatility") / F.when(cum > 0, cum)),
    })
