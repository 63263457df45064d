"""Tail risk: VaR and expected shortfall, exceptions, Kupiec and Christoffersen tests, filtered historical simulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrace.functions.special import chi2_sf_1, chi2_sf_2, safe_div, xlogy
from voltrace.operators import scan
from voltrace.operators.quantiles import BOUND, exact_quantiles
from voltrace.runtime import numbered

LEVELS = (0.95, 0.99)


class RiskError(ValueError):
    """Invalid levels or too few observations."""


def _level(c: float) -> float:
    if not 0 < c < 1:
        raise RiskError("a confidence level lies between 0 and 1")
    return c


def calculate_var(returns: DataFrame, column: str = "simulated_return", *, confidence_level: float, by=(), bound: int = BOUND) -> DataFrame:
    """(by..., confidence_level, value_at_risk, observations): minus the exact (1 - c) quantile, interpolated linearly. No task holds more than bound values of a group."""
    q = exact_quantiles(returns, column, [1 - _level(confidence_level)], by, bound=bound)
    return q.select(*by, F.lit(confidence_level).alias("confidence_level"), (-F.get("q", F.lit(0))).alias("value_at_risk"), F.col("n").alias("observations"))


def calculate_var_95(returns: DataFrame, column: str = "simulated_return", by=()) -> DataFrame:
    return calculate_var(returns, column, confidence_level=0.95, by=by)


def calculate_var_99(returns: DataFrame, column: str = "simulated_return", by=()) -> DataFrame:
    return calculate_var(returns, column, confidence_level=0.99, by=by)


def calculate_required_var_levels(returns: DataFrame, column: str = "simulated_return", by=(), *, bound: int = BOUND) -> DataFrame:
    """Both levels from one selection."""
    q = exact_quantiles(returns, column, [1 - c for c in LEVELS], by, bound=bound)
    return q.select(*by, (-F.get("q", F.lit(0))).alias("var_95"), (-F.get("q", F.lit(1))).alias("var_99"), F.col("n").alias("observations"))


def calculate_required_es_levels(returns: DataFrame, column: str = "simulated_return", *, confidence_levels=LEVELS, by=(), bound: int = BOUND) -> DataFrame:
    """(by..., confidence_level, value_at_risk, expected_shortfall, tail_count): minus the mean of returns at or below the quantile."""
    levels = [_level(c) for c in confidence_levels]
    if len(set(levels)) != len(levels):
        raise RiskError("repeated confidence levels")
    q = exact_quantiles(returns, column, [1 - c for c in levels], by, bound=bound)
    pairs = q.select(*by, F.explode(F.arrays_zip(F.array(*map(F.lit, levels)).alias("level"), F.col("q").alias("cut"))).alias("z")).select(*by, F.col("z.level").alias("confidence_level"), F.col("z.cut").alias("cut"))
    # A row for each group and level, which the planner broadcasts if they are few; without groups, a row for each level.
    tail = returns.join(pairs, list(by)) if by else returns.crossJoin(F.broadcast(pairs))
    return tail.groupBy(*by, "confidence_level", "cut").agg(
        (-F.avg(F.when(F.col(column) <= F.col("cut"), F.col(column)))).alias("expected_shortfall"), F.count_if(F.col(column) <= F.col("cut")).alias("tail_count"),
    ).select(*by, "confidence_level", (-F.col("cut")).alias("value_at_risk"), "expected_shortfall", "tail_count")


def calculate_expected_shortfall(returns: DataFrame, confidence_level: float, column: str = "simulated_return", by=()) -> DataFrame:
    return calculate_required_es_levels(returns, column, confidence_levels=(confidence_level,), by=by)


def calculate_es_95(returns: DataFrame, column: str = "simulated_return", by=()) -> DataFrame:
    return calculate_expected_shortfall(returns, 0.95, column, by)


def calculate_es_99(returns: DataFrame, column: str = "simulated_return", by=()) -> DataFrame:
    return calculate_expected_shortfall(returns, 0.99, column, by)


# Backtests ----------------------------------------------------------------------


def exception(actual: str = "actual_return", var: str = "var_loss") -> Column:
    """An exception: the return is at or below minus VaR. Null or negative VaR gives none."""
    return F.when(F.col(var) >= 0, F.col(actual) <= -F.col(var))


def identify_exceptions(df: DataFrame, actual: str = "actual_return", var: str = "var_loss") -> DataFrame:
    return df.withColumn("exception", exception(actual, var))


def prepare_var_backtest(df: DataFrame, actual: str = "actual_return", var: str = "var_loss", by=()) -> DataFrame:
    e = exception(actual, var)
    return df.groupBy(*by).agg(F.count(e).alias("observation_count"), F.count_if(e).alias("exception_count"), F.avg(e.cast("int")).alias("exception_rate"), F.count_if(F.col(var) < 0).alias("invalid_var"))


def exception_count(df: DataFrame, actual: str = "actual_return", var: str = "var_loss", by=()) -> DataFrame:
    return prepare_var_backtest(df, actual, var, by).select(*by, "exception_count")


def exception_rate(df: DataFrame, actual: str = "actual_return", var: str = "var_loss", by=()) -> DataFrame:
    return prepare_var_backtest(df, actual, var, by).select(*by, "exception_rate")


def binomial_log_likelihood(successes: Column, trials: Column, p: Column) -> Column:
    return xlogy(successes, p) + xlogy(trials - successes, 1 - p)


def lr_unconditional(exceptions: Column, n: Column, p: Column) -> Column:
    return F.greatest(-2 * (binomial_log_likelihood(exceptions, n, p) - binomial_log_likelihood(exceptions, n, exceptions / F.when(n > 0, n))), F.lit(0.0))


def kupiec_unconditional_coverage(df: DataFrame, confidence_level: float, *, actual: str = "actual_return", var: str = "var_loss", significance_level: float = 0.05, by=()) -> DataFrame:
    expected = 1 - _level(confidence_level)
    base = prepare_var_backtest(df, actual, var, by)
    lr = lr_unconditional(F.col("exception_count"), F.col("observation_count"), F.lit(expected))
    out = base.select(*by, "observation_count", "exception_count", "exception_rate", F.lit(confidence_level).alias("confidence_level"), F.lit(expected).alias("expected_rate"),
                      (F.col("observation_count") * expected).alias("expected_exceptions"), lr.alias("lr_uc"))
    return out.withColumn("p_value", chi2_sf_1(F.col("lr_uc"))).withColumn("reject", F.col("p_value") < significance_level)


def kupiec_95(df: DataFrame, **options) -> DataFrame:
    return kupiec_unconditional_coverage(df, 0.95, **options)


def kupiec_99(df: DataFrame, **options) -> DataFrame:
    return kupiec_unconditional_coverage(df, 0.99, **options)


def calculate_transition_counts(df: DataFrame, *, exception_column: str = "exception", order=("timestamp",), by=()) -> DataFrame:
    """(by..., n00, n01, n10, n11) of consecutive observations."""
    e = F.col(exception_column).cast("int")
    steps = scan.previous(df.select(*by, *order, e.alias("e")), "e", by, order, "before", "transitions")
    return steps.groupBy(*by).agg(*(F.count_if((F.col("before") == i) & (F.col("e") == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)))


def lr_independence(n00: Column, n01: Column, n10: Column, n11: Column) -> Column:
    """Markov against independence; a row of the transition table without observations adds nothing."""
    p01 = F.coalesce(safe_div(n01, n00 + n01), F.lit(0.0))
    p11 = F.coalesce(safe_div(n11, n10 + n11), F.lit(0.0))
    p = F.coalesce(safe_div(n01 + n11, n00 + n01 + n10 + n11), F.lit(0.0))
    free = xlogy(n01, p01) + xlogy(n00, 1 - p01) + xlogy(n11, p11) + xlogy(n10, 1 - p11)
    return F.greatest(-2 * (xlogy(n01 + n11, p) + xlogy(n00 + n10, 1 - p) - free), F.lit(0.0))


def christoffersen_test(df: DataFrame, confidence_level: float, *, actual: str = "actual_return", var: str = "var_loss", order=("timestamp",), significance_level: float = 0.05, by=()) -> DataFrame:
    """Independence, unconditional and conditional coverage. The first uses n - 1 transitions, the second n observations."""
    marked = identify_exceptions(df, actual, var).filter(F.col("exception").isNotNull())
    moves = calculate_transition_counts(marked, order=order, by=by)
    total = marked.groupBy(*by).agg(F.count(F.lit(1)).alias("observation_count"), F.count_if("exception").alias("exception_count"))
    both = moves.join(total, list(by)) if by else moves.crossJoin(total)  # one row each
    n = [F.col(c) for c in ("n00", "n01", "n10", "n11")]
    out = both.withColumn("pi01", F.coalesce(safe_div(n[1], n[0] + n[1]), F.lit(0.0))).withColumn("pi11", F.coalesce(safe_div(n[3], n[2] + n[3]), F.lit(0.0)))
    out = out.withColumn("lr_ind", lr_independence(*n)).withColumn("lr_uc", lr_unconditional(F.col("exception_count"), F.col("observation_count"), F.lit(1 - _level(confidence_level))))
    out = out.withColumn("lr_cc", F.col("lr_ind") + F.col("lr_uc"))
    out = out.withColumn("p_ind", chi2_sf_1(F.col("lr_ind"))).withColumn("p_uc", chi2_sf_1(F.col("lr_uc"))).withColumn("p_cc", chi2_sf_2(F.col("lr_cc")))
    return out.withColumn("reject_ind", F.col("p_ind") < significance_level).withColumn("reject_cc", F.col("p_cc") < significance_level)


def christoffersen_95(df: DataFrame, **options) -> DataFrame:
    return christoffersen_test(df, 0.95, **options)


def christoffersen_99(df: DataFrame, **options) -> DataFrame:
    return christoffersen_test(df, 0.99, **options)


# Filtered historical simulation -------------------------------------------------


def standardized_returns(df: DataFrame, *, min_observations: int = 100, by=()) -> DataFrame:
    """(by..., timestamp, asset_id, z): return over forecast volatility, where finite and positive. Fails below min_observations (of any group)."""
    z = F.when(F.col("forecast_volatility") > 0, F.col("return") / F.when(F.col("forecast_volatility") > 0, F.col("forecast_volatility")))
    out = df.withColumn("z", z).filter(F.col("z").isNotNull() & ~F.isnan("z") & (F.abs("z") != float("inf"))).select(*{*by, "timestamp", "asset_id"}, "z")
    short = out.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < min_observations)
    if not short.isEmpty() or out.isEmpty():
        raise RiskError(f"fewer than {min_observations} standardized returns")
    return out


def simulate(z: DataFrame, forecast_volatility: float, *, n_simulations: int = 10_000, seed: int = 42) -> DataFrame:
    """(draw, simulated_return): draws of z with replacement times the volatility.

    Row numbers of z by a hash of its key, and a hashed index per draw, joined: no task holds all of z, and reruns agree.
    """
    n = z.count()
    spread = z.withColumn("h", F.xxhash64(F.lit(seed), "timestamp", "asset_id", "z"))
    placed = numbered(spread, "h", "timestamp", "asset_id", tag="fhs-z").select("z", "position")
    draws = z.sparkSession.range(n_simulations).select(F.col("id").alias("draw"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("position"))
    return draws.join(placed, "position").select("draw", (F.col("z") * forecast_volatility).alias("simulated_return"))


def filtered_historical_simulation(df: DataFrame, forecast_volatility: float, *, min_observations: int = 100, n_simulations: int = 10_000, seed: int = 42) -> DataFrame:
    """fit and simulate, over the pooled residuals of all assets."""
    return simulate(standardized_returns(df, min_observations=min_observations), forecast_volatility, n_simulations=n_simulations, seed=seed)
