"""Further queries of the catalog: results with metadata, single forms, and models by asset."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from voltrace.operators import asof, evaluation, ewma, features, histogram_trees, models, portfolio, quantiles, risk, scan, stress, volatility, walkforward
from voltrace.operators.kernels import boost, hmm
from voltrace.plans.catalog import (
    BACKTEST, COSTS, HOURLY, STRESS, TURNOVER, USABLE, WEIGHTS, _UC, _chi2_1, _ll, backtest_rows, bars, cost_rows, registered, rounded, stress_rows, usable_panel, weights)
from voltrace.plans import experiments
from voltrace.runtime import shared_dir, table
from voltrace.sources import contract, files, registry

_META = "count(*) AS row_count, count(DISTINCT asset_id) AS asset_count"


@registered("chronological_order", """WITH t AS (SELECT upper(trim(event_type)) AS asset_id, ts < lag(ts) OVER (PARTITION BY upper(trim(event_type)) ORDER BY event_id) AS back FROM events)
SELECT asset_id, count(*) FILTER (back) AS n FROM t GROUP BY 1""")
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.upper(F.trim("event_type")).alias("asset_id"), F.col("ts").cast("timestamp").alias("timestamp"), "event_id")
    return contract.validate_chronological_order(rows, "event_id")


@registered("realized_volatility_result", f"{HOURLY} SELECT {_META}, min(trading_date) AS start, max(trading_date) AS \"end\" FROM rv")
def _(spark, sf):
    return volatility.build_realized_volatility_result(bars(spark, sf))[1]


@registered("target_result", f"{HOURLY}, t AS (SELECT *, lead(realized_volatility) OVER (PARTITION BY asset_id ORDER BY trading_date) AS target FROM rv) SELECT {_META}, min(trading_date) AS start, max(trading_date) AS \"end\" FROM t WHERE target IS NOT NULL")
def _(spark, sf):
    return volatility.build_target_result(volatility.compute_realized_volatility(bars(spark, sf)))[1]


@registered("rolling_feature_result", f"{HOURLY} SELECT {_META}, min(timestamp) AS start, max(timestamp) AS \"end\", 'rolling_volatility_5,rolling_volume_5,rolling_range_5,momentum_5' AS feature_columns FROM bars")
def _(spark, sf):
    return features.build_rolling_feature_result(bars(spark, sf), windows=(5,))[1].withColumn("feature_columns", F.array_join("feature_columns", ","))


@registered("cross_asset_feature_result", f"{HOURLY} SELECT {_META}, min(timestamp) AS start, max(timestamp) AS \"end\" FROM bars")
def _(spark, sf):
    return features.build_cross_asset_feature_result(bars(spark, sf))[1].drop("feature_columns")


@registered("garch_feature_contract", f"{USABLE} SELECT timestamp, asset_id, round(naive, 6) AS garch_forecast FROM ok")
def _(spark, sf):
    return rounded(features.create_garch_features(usable_panel(spark, sf).withColumn("garch_forecast", F.col("naive"))))


@registered("ewma_series", f"""{USABLE},
x AS (SELECT timestamp, asset_id, "return" AS r, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp) - 1 AS i FROM ok),
f AS (SELECT asset_id, r * r AS first FROM x WHERE i = 0)
SELECT a.asset_id, a.timestamp, round(a.r, 6) AS "return", round(max(pow(0.94, a.i) * first) + 0.06 * coalesce(sum(pow(0.94, a.i - 1 - b.i) * b.r * b.r), 0), 6) AS variance,
       round(sqrt(max(pow(0.94, a.i) * first) + 0.06 * coalesce(sum(pow(0.94, a.i - 1 - b.i) * b.r * b.r), 0)), 6) AS volatility
FROM x a JOIN f USING (asset_id) LEFT JOIN x b ON b.asset_id = a.asset_id AND b.i < a.i GROUP BY a.asset_id, a.timestamp, a.r""")
def _(spark, sf):
    return rounded(ewma.transform(usable_panel(spark, sf)))


@registered("fold_by_positions", f"""{USABLE}, one AS (SELECT *, row_number() OVER (ORDER BY timestamp, asset_id) - 1 AS k FROM ok)
SELECT timestamp, asset_id, CASE WHEN k < 120 THEN 'train' ELSE 'test' END AS role, 3 AS fold_id FROM one WHERE k >= 20 AND k < 130""")
def _(spark, sf):
    return walkforward.create_fold_from_positions(usable_panel(spark, sf).select("timestamp", "asset_id"), fold_id=3, train_start=20, train_end=120, test_start=120, test_end=130)


@registered("split_by_row", f"""{USABLE}, one AS (SELECT *, row_number() OVER (ORDER BY timestamp) - 1 AS k FROM ok),
f AS (SELECT f AS fold_id FROM range(0, (SELECT (count(*) - 100 - 10) // 500 + 1 FROM one)) t(f))
SELECT fold_id::INTEGER AS fold_id, a.timestamp AS train_start, b.timestamp AS train_end, c.timestamp AS test_start, d.timestamp AS test_end
FROM f JOIN one a ON a.k = 0 JOIN one b ON b.k = fold_id * 500 + 99 JOIN one c ON c.k = fold_id * 500 + 100 JOIN one d ON d.k = fold_id * 500 + 109""")
def _(spark, sf):
    return walkforward.split_indices(usable_panel(spark, sf), train_size=100, test_size=10, step_size=500, expanding=True)


@registered("prediction_checks", f"""{USABLE}, t AS (SELECT *, row_number() OVER (ORDER BY timestamp, asset_id) AS k FROM ok)
SELECT count(*) FILTER (k % 7 = 0) AS missing, 0::BIGINT AS unexpected, 0::BIGINT AS repeated, count(*) FILTER (k % 7 <> 0 AND "return" < 0)::BIGINT AS invalid FROM t""")
def _(spark, sf):
    rows = scan.positions(usable_panel(spark, sf).withColumn("fold_id", F.lit(0)), (), ("timestamp", "asset_id"), "k").withColumn("k", F.col("k") + 1)
    return walkforward.validate_predictions(rows.filter("k % 7 <> 0").withColumn("prediction", F.col("return")), rows)


@registered("loss_difference", f"{USABLE} SELECT timestamp, asset_id, round(abs(target - naive) - abs(target - older), 6) AS loss_difference FROM ok")
def _(spark, sf):
    return rounded(evaluation.calculate_loss_difference(usable_panel(spark, sf), actual="target", forecast_a="naive", forecast_b="older", kind="absolute").select("timestamp", "asset_id", "loss_difference"))


@registered("single_forecast_metrics", f"""{USABLE} SELECT count(*) AS observations, round(avg(abs(target - naive)), 6) AS mae, round(sqrt(avg((target - naive) * (target - naive))), 6) AS rmse,
round(avg(target / naive - ln(target / naive) - 1), 6) AS qlike, 0::BIGINT AS qlike_violations FROM ok""")
def _(spark, sf):
    return rounded(evaluation.evaluate_forecast_dataframe(usable_panel(spark, sf), actual_column="target", forecast_column="naive"))


for _level in (95, 99):
    _p = round(1 - _level / 100, 2)

    @registered(f"var_{_level}", f"{USABLE} SELECT {_level / 100}::DOUBLE AS confidence_level, round(-quantile_cont(\"return\", {_p}), 6) AS value_at_risk, count(*) AS observations FROM ok")
    def _(spark, sf, level=_level):
        return rounded(risk.calculate_var(usable_panel(spark, sf), "return", confidence_level=level / 100))

    @registered(f"es_{_level}", f"""{USABLE}, q AS (SELECT quantile_cont("return", {_p}) AS cut FROM ok)
SELECT {_level / 100}::DOUBLE AS confidence_level, round(-cut, 6) AS value_at_risk, round(-avg("return"), 6) AS expected_shortfall, count(*) AS tail_count FROM ok, q WHERE "return" <= cut GROUP BY cut""")
    def _(spark, sf, level=_level):
        return rounded(risk.calculate_expected_shortfall(usable_panel(spark, sf), level / 100, "return"))


@registered("exceptions", f"{BACKTEST} SELECT timestamp, asset_id, e AS exception FROM bt")
def _(spark, sf):
    return risk.identify_exceptions(backtest_rows(spark, sf)).select("timestamp", "asset_id", "exception")


@registered("exception_counts", f"{BACKTEST} SELECT asset_id, count(*) FILTER (e) AS exception_count, round(avg(e::INTEGER), 6) AS exception_rate FROM bt GROUP BY 1")
def _(spark, sf):
    rows = backtest_rows(spark, sf)
    return rounded(risk.exception_count(rows, by=("asset_id",)).join(risk.exception_rate(rows, by=("asset_id",)), "asset_id"))


@registered("exception_transitions", f"""{BACKTEST}, m AS (SELECT *, lag(e) OVER (PARTITION BY asset_id ORDER BY timestamp) AS b FROM bt)
SELECT asset_id, count(*) FILTER (NOT b AND NOT e) AS n00, count(*) FILTER (NOT b AND e) AS n01, count(*) FILTER (b AND NOT e) AS n10, count(*) FILTER (b AND e) AS n11 FROM m GROUP BY 1""")
def _(spark, sf):
    return risk.calculate_transition_counts(risk.identify_exceptions(backtest_rows(spark, sf)), by=("asset_id",))


@registered("risk_targeting_result", f"{WEIGHTS} SELECT count(*) AS row_count, count(DISTINCT asset_id) AS asset_count, round(max(abs(weight)), 6) AS max_abs_weight FROM w")
def _(spark, sf):
    base = weights(spark, sf).drop("weight")
    return rounded(portfolio.build_risk_targeting_result(base, target_volatility=0.1, max_position=0.8)[1])


@registered("cost_analysis", f"""{COSTS} SELECT 0.001::DOUBLE AS cost_rate, count(*) AS observation_count, round(sum(turnover), 6) AS total_turnover, round(sum(gross_return), 6) AS total_gross_return,
round(sum(turnover) * 0.001, 6) AS total_transaction_cost, round(sum(gross_return) - sum(turnover) * 0.001, 6) AS total_net_return FROM ct""")
def _(spark, sf):
    return rounded(portfolio.build_cost_analysis(cost_rows(spark, sf), cost_rate=0.001))


@registered("turnover_total", f"{TURNOVER} SELECT round(sum(turnover), 6) AS total FROM to_")
def _(spark, sf):
    return rounded(portfolio.turnover_by_time(weights(spark, sf)).agg(F.sum("turnover").alias("total")))


@registered("normal_volatility", f"{STRESS} SELECT timestamp, asset_id, round(v, 6) AS volatility FROM st, q WHERE v BETWEEN q0 AND q50")
def _(spark, sf):
    return rounded(stress.identify_normal_volatility(stress_rows(spark, sf)).select("timestamp", "asset_id", "volatility"))


@registered("volatility_spikes", f"{STRESS} SELECT timestamp, asset_id, round(v, 6) AS volatility FROM st, q WHERE v >= q99")
def _(spark, sf):
    return rounded(stress.identify_volatility_spikes(stress_rows(spark, sf)).select("timestamp", "asset_id", "volatility"))


@registered("historical_window", f"{STRESS} SELECT timestamp, asset_id, round(r, 6) AS \"return\" FROM st WHERE timestamp::DATE BETWEEN DATE '1995-03-01' AND DATE '1995-04-15'")
def _(spark, sf):
    return rounded(stress.select_historical_window(stress_rows(spark, sf), start_date="1995-03-01", end_date="1995-04-15").select("timestamp", "asset_id", "return"))


@registered("single_stress_scenario", f"""{STRESS},
x AS (SELECT * FROM st WHERE year(timestamp) = 1996), wl AS (SELECT *, product(1 + r) OVER (ORDER BY timestamp, asset_id) AS wealth FROM x),
dd AS (SELECT *, wealth / max(wealth) OVER (ORDER BY timestamp, asset_id) - 1 AS d FROM wl)
SELECT 'year_1996' AS scenario, count(*) AS observation_count, count(DISTINCT asset_id) AS asset_count, round(sum(r), 6) AS total_return, round(avg(r), 6) AS mean_return, round(coalesce(stddev_samp(r), 0) * sqrt(252), 6) AS volatility,
       round(sqrt(avg(pow(least(r, 0), 2))) * sqrt(252), 6) AS downside_deviation, round(min(d), 6) AS max_drawdown, round(product(1 + r) - 1, 6) AS cumulative_return FROM dd""")
def _(spark, sf):
    rows = stress_rows(spark, sf).filter(F.year("timestamp") == 1996)
    return rounded(stress.run_stress_scenario(rows, scenario_name="year_1996"))


# Models by asset ----------------------------------------------------------------


@registered("gjr_garch_fit", None)
def _(spark, sf):
    return rounded(models.fit_gjr_garch(usable_panel(spark, sf)))


@registered("conditional_volatility", None)
def _(spark, sf):
    return rounded(models.conditional_volatility(usable_panel(spark, sf)))


@registered("regimes", None)
def _(spark, sf):
    return rounded(models.predict_regimes(models.fit_hmm(usable_panel(spark, sf), ["return", "volatility"])))


@registered("trees_by_asset", None)
def _(spark, sf):
    return rounded(models.fit_trees(usable_panel(spark, sf), ["return", "naive", "older"]))


@registered("pooled_trees", None)
def _(spark, sf):
    rows = usable_panel(spark, sf)
    return rounded(models.PooledTrees(n_estimators=5, max_depth=3).fit_predict(rows, feature_columns=["return", "naive", "older"]))


@registered("feature_importance", None)
def _(spark, sf):
    m = models.PooledTrees(n_estimators=5, max_depth=3).fit(usable_panel(spark, sf), feature_columns=["return", "naive", "older"])
    return rounded(m.feature_importance(spark))


@registered("simulated_risk_by_asset", None)
def _(spark, sf):
    rows = usable_panel(spark, sf).withColumn("forecast_volatility", F.col("naive"))
    z = risk.standardized_returns(rows, by=("asset_id",))
    last = rows.groupBy("asset_id").agg(F.max_by("naive", "timestamp").alias("forecast_volatility"))
    return rounded(risk.calculate_required_es_levels(models.simulate_by_group(z, last, n_simulations=10_000), by=("asset_id",)))


# Sources and sinks --------------------------------------------------------------

_BARS = "round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume"


def _stored(spark, name: str) -> str:
    return f"{shared_dir(spark)}/voltrace/{uuid.uuid4().hex}-{name}"


@registered("csv_round_trip", f"{HOURLY} SELECT timestamp, asset_id, {_BARS} FROM bars")
def _(spark, sf):
    return rounded(files.load_csv(spark, files.save_csv(bars(spark, sf), _stored(spark, "bars.csv"))))


@registered("csv_raw", f"{HOURLY} SELECT timestamp, asset_id, {_BARS} FROM bars")
def _(spark, sf):
    raw = files.load_csv_raw(spark, files.save_csv(bars(spark, sf), _stored(spark, "bars.csv")))
    return rounded(raw.select(F.col("timestamp").cast("timestamp").alias("timestamp"), "asset_id", *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume"))))


@registered("parquet_round_trip", f"{HOURLY} SELECT timestamp, asset_id, {_BARS} FROM bars")
def _(spark, sf):
    return rounded(files.load_and_verify_parquet(spark, files.save_parquet(bars(spark, sf), _stored(spark, "bars.parquet"), partition_by_asset=True)).select(*contract.canonical_columns(bars(spark, sf)).columns))


@registered("canonical_parquet_round_trip", f"{HOURLY} SELECT timestamp, asset_id, {_BARS} FROM bars")
def _(spark, sf):
    path = _stored(spark, "bars.parquet")
    files.canonicalize_and_save(bars(spark, sf), path)
    return rounded(files.load_canonical_parquet(spark, path))


@registered("raw_dataset", f"{HOURLY} SELECT timestamp, asset_id, {_BARS} FROM bars WHERE asset_id IN (SELECT min(asset_id) FROM bars UNION SELECT max(asset_id) FROM bars) AND timestamp >= (SELECT min(timestamp) + INTERVAL 3 DAY FROM bars)")
def _(spark, sf):
    path = files.save_parquet(bars(spark, sf), _stored(spark, "bars.parquet"))
    about = bars(spark, sf).agg(F.min("asset_id").alias("low"), F.max("asset_id").alias("up"), (F.min("timestamp") + F.expr("INTERVAL 3 DAYS")).alias("start")).first()
    return rounded(files.load_raw_dataset(spark, path, assets=[about.low.lower(), about.up], start=about.start))


@registered("artifact_round_trip", f"{HOURLY} SELECT asset_id, trading_date, round(realized_volatility, 6) AS realized_volatility FROM rv")
def _(spark, sf):
    out = _stored(spark, "artifacts")
    files.save_dataframe_artifact(volatility.compute_realized_volatility(bars(spark, sf)), out)
    return rounded(files.load_dataframe_artifact(spark, out).select("asset_id", "trading_date", "realized_volatility"))


@registered("registry_datasets", f"{HOURLY} SELECT asset_id AS name, min(timestamp)::VARCHAR AS start_date, count(*)::VARCHAR AS metadata FROM bars GROUP BY 1")
def _(spark, sf):
    made = registry.Registry(spark, _stored(spark, "registry"))
    made.initialize()
    about = bars(spark, sf).groupBy("asset_id").agg(F.date_format(F.min("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("start"), F.count(F.lit(1)).alias("n"))
    for r in about.collect():  # a record for each asset, as a service would register them
        made.save_dataset({"name": r.asset_id, "start_date": r.start, "metadata": str(r.n)})
    return made.list_datasets().select("name", "start_date", "metadata")


_RESEARCH = f"""{HOURLY},
nxt AS (SELECT asset_id, trading_date, lead(realized_volatility) OVER (PARTITION BY asset_id ORDER BY trading_date) AS target
        FROM (SELECT l.asset_id, l.timestamp::DATE AS trading_date, max(v.realized_volatility) AS realized_volatility FROM lr l LEFT JOIN rv v ON v.asset_id = l.asset_id AND v.trading_date = l.timestamp::DATE WHERE r IS NOT NULL GROUP BY 1, 2)),
ok AS (SELECT l.timestamp, l.asset_id, l.r AS "return", n.target FROM lr l JOIN rv v ON v.asset_id = l.asset_id AND v.trading_date = l.timestamp::DATE JOIN nxt n ON n.asset_id = l.asset_id AND n.trading_date = l.timestamp::DATE
       WHERE l.r IS NOT NULL AND n.target IS NOT NULL)"""
_EXPERIMENT = f"""{_RESEARCH},
cal AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS k FROM (SELECT DISTINCT timestamp FROM ok)),
folds AS (SELECT f AS fold_id FROM range(0, (SELECT count(*) - 120 FROM cal)) t(f)),
placed AS (SELECT o.*, fold_id, CASE WHEN k < fold_id + 120 THEN 'train' ELSE 'test' END AS role FROM ok o JOIN cal USING (timestamp) JOIN folds ON k BETWEEN fold_id AND fold_id + 120),
numbered AS (SELECT *, row_number() OVER (PARTITION BY fold_id, asset_id ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY fold_id, asset_id) AS n FROM placed WHERE role = 'train'),
v AS (SELECT fold_id, asset_id, sqrt(max(pow(0.94, n)) * arg_min("return" * "return", i) + 0.06 * sum(pow(0.94, n - 1 - i) * "return" * "return")) AS prediction FROM numbered GROUP BY 1, 2),
pred AS (SELECT p.timestamp, p.asset_id, v.prediction AS forecast, p.target AS actual, p.fold_id, 'EWMA' AS model FROM placed p JOIN v USING (fold_id, asset_id) WHERE role = 'test')"""


def _service(spark, sf) -> experiments.Service:
    """Registers the bars, runs an experiment over them (120 timestamps of training, every next one forecast) and leaves its artifacts."""
    made = registry.Registry(spark, _stored(spark, "registry"))
    made.initialize()
    service = experiments.Service(spark, made, _stored(spark, "artifacts"))
    service.create_dataset({"name": "bars", "path": files.save_parquet(bars(spark, sf), _stored(spark, "bars.parquet"))})
    service.create_experiment({"name": "hourly", "models": ["EWMA"], "parameters": {"dataset": "bars", "train_size": 120, "test_size": 1, "step_size": 1}})
    done = service.run_experiments(["hourly"])
    if not done.all_successful:
        raise RuntimeError(done.results[0].error)
    return service


@registered("experiment_forecasts", f"""{_EXPERIMENT}
SELECT model, count(*) AS observations, round(avg(abs(actual - forecast)), 6) AS mae, round(sqrt(avg((actual - forecast) * (actual - forecast))), 6) AS rmse,
       round(avg(actual / forecast - ln(actual / forecast) - 1) FILTER (actual > 0 AND forecast > 0), 6) AS qlike, count(*) FILTER (actual <= 0 OR forecast <= 0) AS qlike_violations FROM pred GROUP BY 1""")
def _(spark, sf):
    return rounded(_service(spark, sf).compare_forecasts("hourly"))


@registered("experiment_report", f"{_EXPERIMENT} SELECT model, count(*) AS predictions, count(DISTINCT fold_id) AS folds FROM pred GROUP BY 1")
def _(spark, sf):
    return _service(spark, sf).run_report("hourly")["coverage"]


@registered("experiment_predictions", f"{_EXPERIMENT} SELECT timestamp, asset_id, round(forecast, 6) AS prediction, round(actual, 6) AS actual_volatility, fold_id::INTEGER AS fold_id, model FROM pred")
def _(spark, sf):
    service = _service(spark, sf)
    return rounded(files.load_experiment_results(spark, "hourly", output_directory=service.artifacts).select("timestamp", "asset_id", "prediction", "actual_volatility", "fold_id", "model"))


@registered("registry_records", f"""{HOURLY}, a AS (SELECT DISTINCT asset_id FROM bars)
SELECT kind, asset_id AS experiment_name, 'EWMA' AS what, 'accepted' AS status FROM a, (VALUES ('forecast'), ('risk'), ('portfolio'), ('report')) t(kind)""")
def _(spark, sf):
    made = registry.Registry(spark, _stored(spark, "registry"))
    made.initialize()
    service = experiments.Service(spark, made, _stored(spark, "artifacts"))
    for r in bars(spark, sf).select("asset_id").distinct().collect():  # records of each asset, as a service would make them
        for create in (service.create_forecast, service.create_risk_analysis, service.create_portfolio_analysis, service.create_report):
            create(r.asset_id, "EWMA")
    out = None
    for kind, rows, what in (("forecast", made.list_forecasts(), "model"), ("risk", made.list_risks(), "model"), ("portfolio", made.list_portfolios(), "strategy"), ("report", made.list_reports(), "report_type")):
        part = rows.select(F.lit(kind).alias("kind"), "experiment_name", F.col(what).alias("what"), "status")
        out = part if out is None else out.unionByName(part)
    return out


_UC_99 = _UC.replace("ln(0.05)", "ln(0.01)").replace("ln(0.95)", "ln(0.99)")


@registered("kupiec_99", f"""{BACKTEST},
s AS (SELECT asset_id, count(*) AS n, count(*) FILTER (e) AS x FROM bt GROUP BY 1), u AS (SELECT *, {_UC_99} AS lr FROM s)
SELECT asset_id, n AS observation_count, x AS exception_count, round(x / n, 6) AS exception_rate, 0.99::DOUBLE AS confidence_level, round(0.01, 6)::DOUBLE AS expected_rate, round(n * 0.01, 6)::DOUBLE AS expected_exceptions,
       round(lr, 6) AS lr_uc, round({_chi2_1('lr')}, 6) AS p_value, {_chi2_1('lr')} < 0.05 AS reject FROM u""")
def _(spark, sf):
    return rounded(risk.kupiec_99(backtest_rows(spark, sf), by=("asset_id",)))


@registered("christoffersen_99", f"""{BACKTEST},
m AS (SELECT *, lag(e) OVER (PARTITION BY asset_id ORDER BY timestamp) AS b FROM bt),
t AS (SELECT asset_id, count(*) AS n, count(*) FILTER (e) AS x, count(*) FILTER (NOT b AND NOT e) AS n00, count(*) FILTER (NOT b AND e) AS n01, count(*) FILTER (b AND NOT e) AS n10, count(*) FILTER (b AND e) AS n11 FROM m GROUP BY 1),
u AS (SELECT *, n01 / (n00 + n01) AS p01, n11 / (n10 + n11) AS p11, (n01 + n11) / (n00 + n01 + n10 + n11) AS p, {_UC_99} AS lr_uc FROM t),
w AS (SELECT *, greatest(-2 * ({_ll('(n01 + n11)', 'p')} + {_ll('(n00 + n10)', '(1 - p)')} - ({_ll('n01', 'p01')} + {_ll('n00', '(1 - p01)')} + {_ll('n11', 'p11')} + {_ll('n10', '(1 - p11)')})), 0) AS lr_ind FROM u)
SELECT asset_id, n00, n01, n10, n11, n AS observation_count, x AS exception_count, round(p01, 6) AS pi01, round(p11, 6) AS pi11, round(lr_ind, 6) AS lr_ind, round(lr_uc, 6) AS lr_uc, round(lr_ind + lr_uc, 6) AS lr_cc,
       round({_chi2_1('lr_ind')}, 6) AS p_ind, round({_chi2_1('lr_uc')}, 6) AS p_uc, round(exp(-(lr_ind + lr_uc) / 2), 6) AS p_cc, {_chi2_1('lr_ind')} < 0.05 AS reject_ind, exp(-(lr_ind + lr_uc) / 2) < 0.05 AS reject_cc FROM w""")
def _(spark, sf):
    return rounded(risk.christoffersen_99(backtest_rows(spark, sf), by=("asset_id",)))


# Scans over parts of a group ----------------------------------------------------


@registered("weights_with_next_returns", f"""{WEIGHTS},
r AS (SELECT asset_id, timestamp, "return" FROM ok WHERE dayofyear(timestamp) % 3 <> 0)
SELECT r.timestamp, w.asset_id, round(w.weight, 6) AS weight, round(r."return", 6) AS "return" FROM w ASOF JOIN r ON w.asset_id = r.asset_id AND w.timestamp < r.timestamp""")
def _(spark, sf):
    returns = usable_panel(spark, sf).filter(F.dayofyear("timestamp") % 3 != 0)  # gaps, over which a weight waits for its return
    return rounded(asof.next_returns(weights(spark, sf), returns, weight="weight"))


@registered("last_order_before_shipment", """SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, o.o_orderdate AS matched_timestamp, o.spent
FROM lineitem l ASOF LEFT JOIN (SELECT o_orderdate, max(o_totalprice) AS spent FROM orders GROUP BY 1) o ON l.l_shipdate >= o.o_orderdate""")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_shipdate").alias("timestamp"))
    days = table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("timestamp")).agg(F.max("o_totalprice").alias("spent"))
    return asof.asof_join(lines, days, by=(), direction="backward", strict=False, how="left").drop("timestamp")


_PROBABILITIES = (0.0, 0.001, 0.05, 0.5, 0.95, 0.999, 1.0)


@registered("distributed_quantiles", "\nUNION ALL ".join(
    f"SELECT l_returnflag, {p}::DOUBLE AS p, round(quantile_cont(l_extendedprice, {p}), 6) AS quantile, count(l_extendedprice) AS n FROM lineitem GROUP BY 1" for p in _PROBABILITIES))
def _(spark, sf):
    q = quantiles.exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", _PROBABILITIES, ("l_returnflag",), bound=1 << 10)
    pairs = F.arrays_zip(F.array(*map(F.lit, _PROBABILITIES)).alias("p"), F.col("q").alias("quantile"))
    return rounded(q.select("l_returnflag", F.explode(pairs).alias("z"), "n").select("l_returnflag", "z.p", "z.quantile", "n"))


_GARCH = {"mu": 0.001, "omega": 0.01, "alpha": 0.05, "gamma": 0.1, "beta": 0.85}


@registered("garch_variance", USABLE.replace("WITH", "WITH RECURSIVE", 1) + f""",
x AS (SELECT asset_id, timestamp, "return" - {_GARCH['mu']} AS e, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp) AS k FROM ok),
path AS (
  SELECT asset_id, 1::BIGINT AS k, var_pop("return") AS v FROM ok GROUP BY 1
  UNION ALL
  SELECT p.asset_id, p.k + 1, {_GARCH['omega']} + ({_GARCH['alpha']} + CASE WHEN x.e < 0 THEN {_GARCH['gamma']} ELSE 0 END) * x.e * x.e + {_GARCH['beta']} * p.v FROM path p JOIN x USING (asset_id, k))
SELECT x.asset_id, x.timestamp, round(p.v, 6) AS conditional_variance, round(sqrt(p.v), 6) AS conditional_volatility FROM x JOIN path p USING (asset_id, k)""")
def _(spark, sf):
    rows = usable_panel(spark, sf)
    given = rows.select("asset_id").distinct().withColumns({k: F.lit(v) for k, v in _GARCH.items()})
    return rounded(models.garch_variance(rows, given))


#: A fixed model of three states over (return, volatility, range): scaled observations are independent normals in each state.
_STATES = {"start": (0.5, 0.3, 0.2), "transition": ((0.9, 0.07, 0.03), (0.1, 0.8, 0.1), (0.05, 0.15, 0.8)), "means": ((-0.2, -0.6, -0.3), (0.1, 0.2, 0.1), (0.5, 1.0, 0.6)), "deviations": ((0.8, 0.6, 0.9), (1.0, 0.8, 1.0), (1.3, 1.1, 1.2)),
           "mean": (0.15, 0.5, 2.0), "scale": (0.6, 0.3, 1.0)}


def _density_sql(s: int) -> str:
    x = ('"return"', "volatility", "(high - low) / abs(close)")
    z = [f"(({x[j]} - {_STATES['mean'][j]}) / {_STATES['scale'][j]} - {_STATES['means'][s][j]}) / {_STATES['deviations'][s][j]}" for j in range(3)]
    return " - ".join(["0", *(f"0.5 * pow({v}, 2)" for v in z), *(f"ln({_STATES['deviations'][s][j]})" for j in range(3))])


@registered("regime_filter", USABLE.replace("WITH", "WITH RECURSIVE", 1) + f""",
full_ AS (SELECT ok.*, days.high, days.low, days.close FROM ok JOIN days USING (timestamp, asset_id)),
ld AS (SELECT asset_id, timestamp, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp) AS k, {", ".join(f"{_density_sql(s)} AS d{s}" for s in range(3))} FROM full_),
den AS (SELECT asset_id, timestamp, k, {", ".join(f"exp(greatest(d{s} - greatest(d0, d1, d2), -300)) AS b{s}" for s in range(3))} FROM ld),
path AS (
  SELECT asset_id, k, w0 / (w0 + w1 + w2) AS p0, w1 / (w0 + w1 + w2) AS p1, w2 / (w0 + w1 + w2) AS p2 FROM (SELECT asset_id, k, {", ".join(f"b{s} * {_STATES['start'][s]} AS w{s}" for s in range(3))} FROM den WHERE k = 1)
  UNION ALL
  SELECT asset_id, k, w0 / (w0 + w1 + w2), w1 / (w0 + w1 + w2), w2 / (w0 + w1 + w2)
  FROM (SELECT d.asset_id, d.k, {", ".join(f"d.b{s} * (" + " + ".join(f"p.p{r} * {_STATES['transition'][r][s]}" for r in range(3)) + f") AS w{s}" for s in range(3))} FROM path p JOIN den d ON d.asset_id = p.asset_id AND d.k = p.k + 1))
SELECT den.asset_id, den.timestamp, {", ".join(f"round(p{s}, 6) AS regime_probability_{s}" for s in range(3))} FROM den JOIN path USING (asset_id, k)""")
def _(spark, sf):
    rows = usable_panel(spark, sf, "high", "low", "close").withColumn("range", (F.col("high") - F.col("low")) / F.abs("close"))
    given = {k: np.array(v) for k, v in _STATES.items()}
    m = hmm.Model(hmm.Config(covariance_type="diag"), given["mean"], given["scale"], given["start"], given["transition"], given["means"], np.array([np.diag(d**2) for d in given["deviations"]]))
    return rounded(models.filter_regimes(rows, ["return", "volatility", "range"], m))


_TREE = {"n_estimators": 1, "max_depth": 2, "learning_rate": 0.3, "reg_alpha": 5.0, "reg_lambda": 1.0}
_TREE_FEATURES, _TREE_BINS = ("naive", "older", "ret0"), 16


def _tree_sql() -> str:
    """One tree of two levels: bins at exact quantiles, gains by (node, feature, bin), the best split of each node, then the leaves' values."""
    a, lam, rate = _TREE["reg_alpha"], _TREE["reg_lambda"], _TREE["learning_rate"]

    def score(g: str, n: str) -> str:
        return f"pow(greatest(abs({g}) - {a}, 0), 2) / ({n} + {lam})"

    edges = ", ".join(f"list_sort(list_distinct([{', '.join(f'quantile_cont({f}, {k / _TREE_BINS})' for k in range(1, _TREE_BINS))}])) AS e_{f}" for f in _TREE_FEATURES)
    bins = ", ".join(f"len(list_filter(e_{f}, lambda e: e <= {f})) AS b{i}" for i, f in enumerate(_TREE_FEATURES))
    parts = [USABLE, 'src AS (SELECT timestamp, asset_id, naive, older, "return" AS ret0, target AS y FROM ok)', f"eds AS (SELECT {edges}, avg(y) AS base FROM src)",
             f"r0 AS (SELECT timestamp, asset_id, base, base - y AS g, {bins}, 0 AS node FROM src, eds)"]
    for level in range(_TREE["max_depth"]):
        each = " UNION ALL ".join(f"SELECT node, {i} AS f, b{i} AS b, sum(g) AS g, count(*) AS n FROM r{level} GROUP BY 1, 3" for i in range(len(_TREE_FEATURES)))
        parts += [
            f"h{level} AS ({each})",
            f"c{level} AS (SELECT node, f, b + 1 AS cut, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(g) OVER (PARTITION BY node, f) AS g, sum(n) OVER (PARTITION BY node, f) AS n FROM h{level} WINDOW w AS (PARTITION BY node, f ORDER BY b))",
            f"s{level} AS (SELECT node, arg_max(f, (gain, -f, -cut)) AS f, arg_max(cut, (gain, -f, -cut)) AS cut FROM (SELECT *, {score('gl', 'nl')} + {score('(g - gl)', '(n - nl)')} - {score('g', 'n')} AS gain FROM c{level} WHERE nl < n) WHERE gain > 1e-12 GROUP BY 1)",
            f"r{level + 1} AS (SELECT r.* REPLACE (CASE WHEN s.f IS NULL THEN r.node WHEN (CASE s.f WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END) < s.cut THEN 2 * r.node + 1 ELSE 2 * r.node + 2 END AS node) FROM r{level} r LEFT JOIN s{level} s USING (node))",
        ]
    last = _TREE["max_depth"]
    parts.append(f"v AS (SELECT node, -{rate} * sign(sum(g)) * greatest(abs(sum(g)) - {a}, 0) / (count(*) + {lam}) AS value FROM r{last} GROUP BY 1)")
    return ",\n".join(parts) + f"\nSELECT timestamp, asset_id, round(greatest(base + value, 0), 6) AS forecast FROM r{last} JOIN v USING (node)"


@registered("histogram_tree", _tree_sql())
def _(spark, sf):
    rows = usable_panel(spark, sf).withColumn("ret0", F.col("return"))
    model = histogram_trees.fit(rows, list(_TREE_FEATURES), config=boost.Config(**_TREE), bins=_TREE_BINS)
    return rounded(model.predict(rows.select("timestamp", "asset_id", *_TREE_FEATURES)).select("timestamp", "asset_id", "forecast"))


@registered("histogram_trees", None)
def _(spark, sf):
    """Ten trees of depth six with draws of rows and features, over the whole panel."""
    rows = usable_panel(spark, sf)
    model = histogram_trees.fit(rows, ["return", "naive", "older"], config=boost.Config(n_estimators=10, subsample=0.8, colsample_bytree=0.7, reg_alpha=0.5))
    return rounded(model.predict(rows.select("timestamp", "asset_id", "return", "naive", "older", "target")))
