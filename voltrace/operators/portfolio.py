"""Risk targeting, position and turnover limits, portfolio returns, performance and costs."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrace.functions.special import clip
from voltrace.operators import scan


class PortfolioError(ValueError):
    """Invalid limits, rates or keys."""


def _positive(x: float, what: str) -> float:
    if not (math.isfinite(x) and x > 0):
        raise PortfolioError(f"{what} must be positive and finite")
    return float(x)


def calculate_risk_targeted_weights(df: DataFrame, *, target_volatility: float, max_position: float) -> DataFrame:
    """Adds target_weight: base weight times target over forecast volatility, within the limit."""
    _positive(target_volatility, "target_volatility"), _positive(max_position, "max_position")
    raw = F.col("base_weight") * target_volatility / F.when(F.col("forecast_volatility") > 0, F.col("forecast_volatility"))
    return df.withColumn("target_weight", clip(raw, -max_position, max_position))


def build_risk_targeting_result(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    out = calculate_risk_targeted_weights(df, **options)
    return out, out.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("asset_id").alias("asset_count"), F.max(F.abs("target_weight")).alias("max_abs_weight"))


def apply_position_limits(weights: DataFrame, *, max_position: float, column: str = "target_weight") -> DataFrame:
    _positive(max_position, "max_position")
    return weights.withColumn(column, clip(F.col(column), -max_position, max_position))


def _sides(current: DataFrame, previous: DataFrame | None, column: str, keys) -> DataFrame:
    now = current.groupBy(*keys, "asset_id").agg(F.sum(column).alias("now"))
    if previous is None:
        return now.withColumn("before", F.lit(0.0))
    before = previous.groupBy(*keys, "asset_id").agg(F.sum(column).alias("before"))
    return now.join(before, [*keys, "asset_id"], "full").select(*keys, "asset_id", F.coalesce("now", F.lit(0.0)).alias("now"), F.coalesce("before", F.lit(0.0)).alias("before"))


def calculate_turnover(current: DataFrame, previous: DataFrame | None = None, *, column: str = "target_weight", keys=()) -> DataFrame:
    """(keys..., turnover, asset_count): sum of absolute changes over the union of assets; nothing before counts as zero."""
    return _sides(current, previous, column, keys).groupBy(*keys).agg(F.sum(F.abs(F.col("now") - F.col("before"))).alias("turnover"), F.count(F.lit(1)).alias("asset_count"))


def apply_turnover_limit(current: DataFrame, previous: DataFrame | None = None, *, max_turnover: float, column: str = "target_weight", compat: bool = False) -> DataFrame:
    """(asset_id, column): changes scaled so that turnover is at most max_turnover.

    Assets that are only in previous are sold like any other; with compat they are left out, as in a left join.
    """
    _positive(max_turnover, "max_turnover")
    sides = _sides(current, previous, column, ())
    if compat:
        sides = sides.join(current.select("asset_id").distinct(), "asset_id", "left_semi")
    total = sides.agg(F.sum(F.abs(F.col("now") - F.col("before"))).alias("total"))
    scale = F.when(F.col("total") > max_turnover, max_turnover / F.when(F.col("total") > 0, F.col("total"))).otherwise(1.0)
    return sides.crossJoin(F.broadcast(total)).select("asset_id", (F.col("before") + (F.col("now") - F.col("before")) * scale).alias(column))  # total: one row


def apply_constraints(weights: DataFrame, *, max_position: float, previous: DataFrame | None = None, max_turnover: float | None = None, column: str = "target_weight") -> tuple[DataFrame, DataFrame]:
    """Position limit, then turnover limit; the weights, and their turnover."""
    limited = apply_position_limits(weights, max_position=max_position, column=column)
    out = limited if max_turnover is None else apply_turnover_limit(limited, previous, max_turnover=max_turnover, column=column)
    return out, calculate_turnover(out, previous, column=column)


def validate_constraints(weights: DataFrame, *, max_position: float, previous: DataFrame | None = None, max_turnover: float | None = None, column: str = "target_weight") -> bool:
    slack = 1e-12
    ok = weights.agg(F.bool_and(F.abs(column) <= max_position + slack).alias("ok")).first().ok
    if ok and max_turnover is not None:
        ok = (calculate_turnover(weights, previous, column=column).first().turnover or 0) <= max_turnover + slack
    return bool(ok)


def sequential_constraints(weights: DataFrame, *, max_position: float, max_turnover: float, portfolio: str = "portfolio_id", column: str = "target_weight") -> DataFrame:
    """(portfolio, timestamp, asset_id, weight, turnover): limits applied in time order, each step from the constrained weights before it.

    The state is sequential within a portfolio, so portfolios are the unit of parallelism; within one, rows are streamed in order.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, held = [], {}
        for ts, rows in pdf.sort_values(["timestamp", "asset_id"]).groupby("timestamp", sort=True):
            want = rows.groupby("asset_id")[column].sum().clip(-max_position, max_position).to_dict()
            names = sorted({*want, *held})
            change = {a: want.get(a, 0.0) - held.get(a, 0.0) for a in names}
            total = sum(map(abs, change.values()))
            scale = max_turnover / total if total > max_turnover else 1.0
            held = {a: held.get(a, 0.0) + change[a] * scale for a in names}
            out += [(rows[portfolio].iloc[0], ts, a, w, total * scale) for a, w in held.items()]
            held = {a: w for a, w in held.items() if w}
        return pd.DataFrame(out, columns=[portfolio, "timestamp", "asset_id", "weight", "turnover"])

    kind = weights.schema[portfolio].dataType.simpleString()
    return weights.select(portfolio, "timestamp", "asset_id", column).groupBy(portfolio).applyInPandas(run, f"{portfolio} {kind}, timestamp timestamp, asset_id string, weight double, turnover double")


def create_static_weights(returns: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(timestamp, asset_id, weight) for every key of returns; assets that aren't named get 0."""
    if any(not math.isfinite(w) for w in weights.values()):
        raise PortfolioError("weights must be finite")
    keys = returns.select("timestamp", "asset_id").distinct()
    if not weights:
        return keys.withColumn("weight", F.lit(0.0))
    named = F.create_map(*[F.lit(x) for a, w in weights.items() for x in (a, float(w))])
    return keys.withColumn("weight", F.coalesce(named[F.col("asset_id")], F.lit(0.0)))


def calculate_portfolio_returns(returns: DataFrame, weights: DataFrame, *, by=()) -> DataFrame:
    """(by..., timestamp, portfolio_return, gross_exposure, net_exposure, asset_count) of the inner join on key, asset ids in upper case.

    A key that either table repeats fails the job: it would count its returns and exposures several times.
    """
    name = F.upper(F.trim("asset_id")).alias("asset_id")
    w = weights.select(*by, "timestamp", name, "weight")
    joined = returns.select("timestamp", name, "return").join(w, ["timestamp", "asset_id"])
    n = F.count(F.lit(1))
    out = joined.groupBy(*by, "timestamp").agg(
        F.sum(F.col("weight") * F.col("return")).alias("portfolio_return"), F.sum(F.abs("weight")).alias("gross_exposure"), F.sum("weight").alias("net_exposure"), n.alias("asset_count"),
        F.count_distinct("asset_id").alias("__assets"))
    whole = F.when(F.col("asset_count") == F.col("__assets"), F.col("asset_count")).otherwise(F.raise_error(F.lit("repeated (timestamp, asset_id) in returns or weights")).cast("long"))
    return out.withColumn("asset_count", whole).drop("__assets")


def wealth_columns(df: DataFrame, column: str, order, by=(), *, from_one: bool = False) -> DataFrame:
    """Adds wealth, peak and drawdown, by parts of a group. The peak starts at the first wealth, or at 1 with from_one (a first loss then shows)."""
    return scan.wealth(df, column, by, order, from_one=from_one)


def calculate_performance(portfolio_returns: DataFrame, *, column: str = "portfolio_return", order=("timestamp",), risk_free_rate: float = 0.0, periods_per_year: int = 252, by=(), from_one: bool = False) -> DataFrame:
    """total_return, annualized_return, annualized_volatility, sharpe_ratio, downside_deviation, sortino_ratio, max_drawdown, calmar_ratio."""
    if periods_per_year < 1:
        raise PortfolioError("periods_per_year must be positive")
    rows = portfolio_returns.filter(F.col(column).isNotNull() & ~F.isnan(column))
    free = (1 + risk_free_rate) ** (1 / periods_per_year) - 1
    root = math.sqrt(periods_per_year)
    walk = wealth_columns(rows, column, order, by, from_one=from_one)
    r = F.col(column)
    down = F.least(r - free, F.lit(0.0))
    base = walk.groupBy(*by).agg(
        F.count(F.lit(1)).alias("observations"), (F.product(1 + r) - 1).alias("total_return"), (F.stddev_samp(r) * root).alias("annualized_volatility"),
        (F.sqrt(F.avg(down * down)) * root).alias("downside_deviation"), F.min("drawdown").alias("max_drawdown"))
    growth = F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), periods_per_year / F.col("observations")) - 1).otherwise(-1.0)
    out = base.withColumn("annualized_return", growth)
    excess = F.col("annualized_return") - risk_free_rate

    def ratio(by_: Column) -> Column:
        return F.when(by_ > 0, excess / F.when(by_ > 0, by_)).otherwise(0.0)

    return out.withColumn("sharpe_ratio", ratio(F.col("annualized_volatility"))).withColumn("sortino_ratio", ratio(F.col("downside_deviation"))).withColumn(
        "calmar_ratio", F.when(F.col("max_drawdown") < 0, F.col("annualized_return") / -F.when(F.col("max_drawdown") < 0, F.col("max_drawdown"))).otherwise(0.0))


# Costs --------------------------------------------------------------------------


def _rate(rate: float) -> float:
    if not (math.isfinite(rate) and rate >= 0):
        raise PortfolioError("a cost rate is finite and not negative")
    return float(rate)


def calculate_transaction_cost(turnover: Column | float, *, cost_rate: float):
    return turnover * _rate(cost_rate)


def calculate_net_return(gross_return, transaction_cost):
    return gross_return - transaction_cost


def calculate_net_returns(df: DataFrame, *, cost_rate: float, turnover_column: str = "turnover", gross_return_column: str = "gross_return") -> DataFrame:
    cost = calculate_transaction_cost(F.col(turnover_column), cost_rate=cost_rate)
    return df.withColumn("transaction_cost", cost).withColumn("net_return", calculate_net_return(F.col(gross_return_column), F.col("transaction_cost")))


def build_cost_analysis(df: DataFrame, *, cost_rate: float, turnover_column: str = "turnover", gross_return_column: str = "gross_return") -> DataFrame:
    return calculate_cost_sensitivity(df, cost_rates=(cost_rate,), turnover_column=turnover_column, gross_return_column=gross_return_column)


def calculate_cost_sensitivity(df: DataFrame, *, cost_rates: Iterable[float], turnover_column: str = "turnover", gross_return_column: str = "gross_return") -> DataFrame:
    """(cost_rate, observation_count, total_turnover, total_gross_return, total_transaction_cost, total_net_return): one pass, then the grid of rates."""
    rates = [_rate(r) for r in cost_rates]
    if not rates or len(set(rates)) != len(rates):
        raise PortfolioError("give distinct cost rates")
    totals = df.agg(F.count(F.lit(1)).alias("observation_count"), F.sum(turnover_column).alias("total_turnover"), F.sum(gross_return_column).alias("total_gross_return"))
    grid = totals.select(F.explode(F.array(*map(F.lit, rates))).alias("cost_rate"), "*")
    out = grid.withColumn("total_transaction_cost", F.col("total_turnover") * F.col("cost_rate"))
    return out.withColumn("total_net_return", F.col("total_gross_return") - F.col("total_transaction_cost"))


def turnover_by_time(weights: DataFrame, *, column: str = "weight", by=()) -> DataFrame:
    """(by..., timestamp, turnover) between consecutive timestamps over the union of their assets; an asset without a row has weight zero.

    An asset that has no row at the next timestamp is sold there. Only the distinct timestamps are ordered as a whole.
    """
    dates = weights.select(*by, "timestamp").distinct()
    line = Window.partitionBy(*by).orderBy("timestamp")
    dates = dates.select(*by, "timestamp", F.lag("timestamp").over(line).alias("__last"), F.lead("timestamp").over(line).alias("__next"))
    own = Window.partitionBy(*by, "asset_id").orderBy("timestamp")
    rows = weights.select(*by, "timestamp", "asset_id", F.col(column).alias("__w")).withColumn("__held", F.lag(F.struct(F.col("timestamp").alias("at"), F.col("__w").alias("w"))).over(own)).withColumn("__then", F.lead("timestamp").over(own))
    rows = rows.join(dates, [*by, "timestamp"])
    before = F.when(F.col("__held.at") == F.col("__last"), F.col("__held.w")).otherwise(0.0)
    sold = F.col("__next").isNotNull() & ~F.coalesce(F.col("__then") == F.col("__next"), F.lit(False))
    moves = F.array(F.struct(F.col("timestamp").alias("at"), F.abs(F.col("__w") - before).alias("change")), F.struct(F.when(sold, F.col("__next")).alias("at"), F.abs("__w").alias("change")))
    return rows.select(*by, F.explode(moves).alias("m")).filter("m.at is not null").groupBy(*by, F.col("m.at").alias("timestamp")).agg(F.sum("m.change").alias("turnover"))
