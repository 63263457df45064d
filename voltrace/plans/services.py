"""Queries of the service's analyses and lookups, of bootstraps by hashed draws, and of recorded responses of the market service."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltrace.operators import resampling
from voltrace.plans import experiments
from voltrace.plans.catalog import HOURLY, ORACLES, USABLE, WEIGHTS, _UC, _chi2_1, _ll, bars, portfolio_returns, registered, rounded, usable_panel
from voltrace.plans.more import _BARS, _EXPERIMENT, _service, _stored
from voltrace.sources import market_api, registry


def _offline(spark) -> experiments.Service:
    """A service for analyses that need no record."""
    return experiments.Service(spark, registry.Registry(spark, _stored(spark, "registry")), _stored(spark, "artifacts"))


@registered("risk_backtest", f"""{USABLE},
bt AS (SELECT model, asset_id, timestamp, "return" <= -0.5 * v AS e FROM (SELECT *, unnest(['naive', 'older']) AS model, unnest([naive, older]) AS v FROM ok)),
m AS (SELECT *, lag(e) OVER (PARTITION BY model, asset_id ORDER BY timestamp) AS b FROM bt),
t AS (SELECT model, asset_id, count(*) AS n, count(*) FILTER (e) AS x, count(*) FILTER (NOT b AND NOT e) AS n00, count(*) FILTER (NOT b AND e) AS n01, count(*) FILTER (b AND NOT e) AS n10, count(*) FILTER (b AND e) AS n11 FROM m GROUP BY 1, 2),
u AS (SELECT *, n01 / (n00 + n01) AS p01, n11 / (n10 + n11) AS p11, (n01 + n11) / (n00 + n01 + n10 + n11) AS p, {_UC} AS lr FROM t),
w AS (SELECT *, greatest(-2 * ({_ll('(n01 + n11)', 'p')} + {_ll('(n00 + n10)', '(1 - p)')} - ({_ll('n01', 'p01')} + {_ll('n00', '(1 - p01)')} + {_ll('n11', 'p11')} + {_ll('n10', '(1 - p11)')})), 0) AS lr_ind FROM u)
SELECT model, asset_id, n AS observation_count, x AS exception_count, round(x / n, 6) AS exception_rate, 0.95::DOUBLE AS confidence_level, 0.05::DOUBLE AS expected_rate, round(n * 0.05, 6)::DOUBLE AS expected_exceptions,
       round(lr, 6) AS lr_uc, round({_chi2_1('lr')}, 6) AS p_value, {_chi2_1('lr')} < 0.05 AS reject, round(lr_ind, 6) AS lr_ind, round(lr_ind + lr, 6) AS lr_cc, round({_chi2_1('lr_ind')}, 6) AS p_ind, round(exp(-(lr_ind + lr) / 2), 6) AS p_cc,
       {_chi2_1('lr_ind')} < 0.05 AS reject_ind, exp(-(lr_ind + lr) / 2) < 0.05 AS reject_cc FROM w""")
def _(spark, sf):
    models = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), (F.col(m) * 0.5).alias("var_loss")) for m in ("naive", "older"))))
    rows = usable_panel(spark, sf).select("asset_id", "timestamp", F.col("return").alias("actual_return"), models.alias("m")).select("asset_id", "timestamp", "actual_return", "m.*")
    return rounded(_offline(spark).compare_risk(rows, 0.95, by=("model", "asset_id")))


@registered("portfolio_comparison", f"""{WEIGHTS},
pr AS (SELECT 'targeted' AS strategy, timestamp, sum(weight * "return") / 1000 AS r FROM w GROUP BY 2 UNION ALL SELECT 'equal', timestamp, avg("return") / 1000 FROM ok GROUP BY 2),
wl AS (SELECT *, product(1 + r) OVER (PARTITION BY strategy ORDER BY timestamp) AS wealth FROM pr),
dd AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY strategy ORDER BY timestamp) - 1 AS drawdown FROM wl),
b AS (SELECT strategy, count(*) AS observations, product(1 + r) - 1 AS total_return, stddev_samp(r) * sqrt(252) AS annualized_volatility, sqrt(avg(pow(least(r, 0), 2))) * sqrt(252) AS downside_deviation, min(drawdown) AS max_drawdown FROM dd GROUP BY 1),
g AS (SELECT *, pow(1 + total_return, 252 / observations) - 1 AS annualized_return FROM b)
SELECT strategy, observations, round(total_return, 6) AS total_return, round(annualized_return, 6) AS annualized_return, round(annualized_volatility, 6) AS annualized_volatility, round(annualized_return / annualized_volatility, 6) AS sharpe_ratio,
       round(downside_deviation, 6) AS downside_deviation, round(annualized_return / downside_deviation, 6) AS sortino_ratio, round(max_drawdown, 6) AS max_drawdown, round(annualized_return / -max_drawdown, 6) AS calmar_ratio FROM g""")
def _(spark, sf):
    targeted = portfolio_returns(spark, sf).select(F.lit("targeted").alias("strategy"), "timestamp", (F.col("portfolio_return") / 1000).alias("portfolio_return"))
    equal = usable_panel(spark, sf).groupBy("timestamp").agg((F.avg("return") / 1000).alias("portfolio_return")).select(F.lit("equal").alias("strategy"), "timestamp", "portfolio_return")
    return rounded(_offline(spark).compare_portfolios(targeted.unionByName(equal), by=("strategy",)))


ORACLE_FORECASTS = ORACLES["experiment_forecasts"]


@registered("forecast_evaluation", f"SELECT * FROM ({ORACLE_FORECASTS}) WHERE model = 'EWMA'")
def _(spark, sf):
    return rounded(_service(spark, sf).evaluate_forecast("hourly", "EWMA"))


@registered("experiment_metrics_report", f"""{_EXPERIMENT}
SELECT model, 'MAE' AS metric, round(avg(abs(actual - forecast)), 6) AS value FROM pred GROUP BY 1
UNION ALL SELECT model, 'RMSE', round(sqrt(avg((actual - forecast) * (actual - forecast))), 6) FROM pred GROUP BY 1""")
def _(spark, sf):
    metrics = _service(spark, sf).run_report("hourly")["metrics"]
    return rounded(metrics.select("model", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m.lower()).alias("value")) for m in ("MAE", "RMSE")))).alias("m")).select("model", "m.*"))


@registered("service_lookups", f"""{HOURLY}, a AS (SELECT asset_id, count(*) AS n, min(timestamp)::DATE::VARCHAR AS first FROM bars GROUP BY 1)
SELECT kind, asset_id AS name, CASE kind WHEN 'dataset' THEN first WHEN 'dataset_valid' THEN 'true' WHEN 'dataset_differs' THEN 'end_date,start_date' WHEN 'experiment' THEN 'registered' ELSE 'accepted' END AS found
FROM a, (VALUES ('dataset'), ('dataset_valid'), ('dataset_differs'), ('experiment'), ('forecast'), ('risk'), ('portfolio'), ('report')) t(kind)""")
def _(spark, sf):
    service = _offline(spark)
    service.registry.initialize()
    rows = []
    about = bars(spark, sf).groupBy("asset_id").agg(F.date_format(F.min("timestamp"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("timestamp"), "yyyy-MM-dd").alias("last"))
    for r in about.collect():  # a record of each kind for each asset, found again by its key or a part of it
        name = r.asset_id
        request = {"name": name, "start_date": r.first, "end_date": r.last, "assets": [name]}
        service.create_dataset(request)
        service.create_experiment({"name": name, "models": ["EWMA"], "parameters": {"assets": [name]}})
        for create in (service.create_forecast, service.create_risk_analysis, service.create_portfolio_analysis, service.create_report):
            create(name, "EWMA")
        rows += [
            ("dataset", name, service.resolve_dataset({"assets": [name]})["start_date"]),
            ("dataset_valid", name, str(service.validate_dataset(request)["valid"]).lower()),
            ("dataset_differs", name, ",".join(service.validate_dataset({"name": name, "start_date": "1900-01-01", "end_date": "1900-01-02"})["differences"])),
            ("experiment", name, service.get_experiment(name)["status"]),
            ("forecast", name, service.get_forecast(name)["status"]), ("risk", name, service.get_risk_analysis(name, "EWMA")["status"]),
            ("portfolio", name, service.get_portfolio_analysis(name)["status"]), ("report", name, service.get_report(name, "EWMA")["status"])]
    return spark.createDataFrame(rows, "kind string, name string, found string")


def _bootstrap_sql(x: str, statistic: str) -> str:
    return f"""{USABLE},
x AS (SELECT row_number() OVER (ORDER BY timestamp, asset_id) - 1 AS pos, {x} AS x FROM ok),
n AS (SELECT count(*) AS n FROM x),
g AS MATERIALIZED (SELECT b, ('0x' || substr(md5('42:' || b::VARCHAR || ':' || k::VARCHAR), 1, 12))::BIGINT % n AS pos FROM range(0, 2000) t(b), (SELECT n, unnest(range(n)) AS k FROM n)),
m AS (SELECT b, {statistic} AS m FROM g JOIN x USING (pos) GROUP BY 1)
SELECT round((SELECT {statistic} FROM x), 6) AS estimate, (SELECT n FROM n) AS observations, round(quantile_cont(m, 0.025), 6) AS "lower", round(quantile_cont(m, 0.975), 6) AS "upper", round(stddev_samp(m), 6) AS standard_error FROM m"""


@registered("bootstrap_sharpe_ratio", _bootstrap_sql('"return"', "avg(x) / stddev_samp(x) * sqrt(252)"))
def _(spark, sf):
    return rounded(resampling.hashed_bootstrap(usable_panel(spark, sf), "return", ("timestamp", "asset_id"), statistic="sharpe"))


@registered("bootstrap_difference", _bootstrap_sql("abs(target - naive) - abs(target - older)", "avg(x)"))
def _(spark, sf):
    rows = usable_panel(spark, sf).withColumn("a", F.abs(F.col("target") - F.col("naive"))).withColumn("b", F.abs(F.col("target") - F.col("older")))
    return rounded(resampling.hashed_bootstrap_difference(rows, "a", "b", ("timestamp", "asset_id")))


@registered("market_responses", f"{HOURLY} SELECT timestamp, asset_id, {_BARS} FROM bars")
def _(spark, sf):
    return rounded(market_api.load_responses(spark, market_api.save_responses(bars(spark, sf), _stored(spark, "responses"))))
