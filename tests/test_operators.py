import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltrace.functions import special
from voltrace.operators import evaluation, ewma, features, portfolio, resampling, risk, stress, volatility, walkforward
from voltrace.operators.kernels import boost, gjr, hmm

DAY = dt.datetime(2024, 1, 1)


def series(n=160, assets=("A", "B"), seed=42):
    rng = np.random.default_rng(seed)
    out = []
    for a in assets:
        r = rng.normal(0.0005, 0.01, n)
        close = 100 * np.exp(np.cumsum(r))
        rv = pd.Series(r).rolling(5).std().bfill().to_numpy()
        for k in range(n):
            out.append((DAY + dt.timedelta(days=k), a, close[k], close[k] * 1.01, close[k] * 0.99, close[k], 1e6 + k, r[k], rv[k], rv[min(k + 1, n - 1)]))
    return pd.DataFrame(out, columns=["timestamp", "asset_id", "open", "high", "low", "close", "volume", "return", "realized_volatility", "target"])


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(series())


def test_special_functions(spark):
    xs = [-6.0, -2.6, -1.0, 0.0, 0.3, 1.0, 2.4, 2.5, 3.0, 5.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.erfc(F.col("x")).alias("e"), special.normal_cdf(F.col("x")).alias("n")).collect()
    for r in got:
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-9, abs=1e-15)
        assert r.n == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=1e-9)


def test_rolling_and_cross_features(spark, panel):
    pdf = panel.toPandas()
    got = features.create_rolling_features(panel).toPandas().sort_values(["asset_id", "timestamp"])
    one = pdf[pdf.asset_id == "A"].sort_values("timestamp")
    want = np.log(one.close).diff().rolling(5).std()
    np.testing.assert_allclose(got[got.asset_id == "A"].rolling_volatility_5.to_numpy(dtype=float), want.to_numpy(), rtol=1e-9)
    cross = features.create_cross_asset_features(panel).toPandas()
    b = np.log(pdf[pdf.asset_id == "B"].sort_values("timestamp").close).diff().to_numpy()
    a = cross[cross.asset_id == "A"].sort_values("timestamp").cross_asset_mean_return.to_numpy(dtype=float)
    np.testing.assert_allclose(a[1:], b[1:], rtol=1e-9)
    with pytest.raises(features.FeatureError):
        features.create_rolling_features(panel, windows=(5, 5))


def test_garch_merge_needs_full_coverage(panel):
    f = panel.select("timestamp", "asset_id", F.col("realized_volatility").alias("garch_forecast"))
    assert features.merge_garch_features(panel, f).count() == panel.count()
    with pytest.raises(features.FeatureError):
        features.merge_garch_features(panel, f.filter("asset_id = 'A'"))


def test_research_dataset_lag(spark):
    rng = np.random.default_rng(1)
    rows = [(DAY + dt.timedelta(days=d, hours=9 + h), "A", *[float(x := 100 + rng.normal())] * 4, 1.0) for d in range(6) for h in range(4)]
    bars = spark.createDataFrame(rows, "timestamp timestamp, asset_id string, open double, high double, low double, close double, volume double")
    same, lagged = volatility.prepare_research_dataset(bars), volatility.prepare_research_dataset(bars, lag_days=1)
    by_day = {r.trading_date: r.realized_volatility for r in same.collect()}
    for r in lagged.collect():
        assert r.realized_volatility == by_day[r.trading_date - dt.timedelta(days=1)]


def test_ewma_forms_agree(panel):
    r = panel.filter("asset_id = 'A'").orderBy("timestamp").toPandas()["return"].to_numpy()
    v = r[0] ** 2
    for k in range(1, len(r) + 1):
        v = 0.94 * v + 0.06 * r[k - 1] ** 2
    got = ewma.calculate_ewma(panel).filter("asset_id = 'A'").first()
    assert got.ewma_variance == pytest.approx(v, rel=1e-12)
    last = ewma.transform(panel).filter("asset_id = 'A'").orderBy(F.desc("timestamp")).first()
    assert 0.94 * last.variance + 0.06 * last["return"] ** 2 == pytest.approx(v, rel=1e-12)


@pytest.mark.parametrize("expanding", [False, True])
def test_folds(panel, expanding):
    table = walkforward.fold_table(panel, train_size=100, test_size=2, step_size=7, expanding=expanding).orderBy("fold_id").collect()
    assert len(table) == (160 - 102) // 7 + 1
    rows = walkforward.assign_folds(panel, train_size=100, test_size=2, step_size=7, expanding=expanding)
    got = {(r.fold_id, r.role): (r.n, r.a, r.b) for r in rows.groupBy("fold_id", "role").agg(F.count_distinct("timestamp").alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).collect()}
    for t in table:
        assert got[t.fold_id, "train"] == (100 + 7 * t.fold_id * expanding, t.train_start, t.train_end)
        assert got[t.fold_id, "test"] == (2, t.test_start, t.test_end)
    assert walkforward.fold_table(panel, train_size=159, test_size=2).count() == 0


def test_models_over_folds(panel):
    options = {"train_size": 120, "test_size": 1, "step_size": 20}
    small = {"boost_config": boost.Config(n_estimators=5, max_depth=2), "hmm_config": hmm.Config(n_components=2, n_iter=20), "feature_columns": ["return", "realized_volatility"]}
    test = walkforward.assign_folds(panel, **options).filter("role = 'test'").withColumn("fold_id", F.col("fold_id").cast("int"))
    for model in walkforward.MODELS:
        out = walkforward.run_model(panel, model, **options, **(small if "XGB" in model else {}))
        assert tuple(walkforward.validate_predictions(out, test).first()) == (0, 0, 0, 0), model
    out = walkforward.run_ablation(panel, "A2", **options, **small)
    p = out.select((F.col("regime_probability_0") + F.col("regime_probability_1")).alias("p")).toPandas()["p"]
    assert np.allclose(p, 1, atol=1e-6)
    with pytest.raises(walkforward.WalkForwardError):
        walkforward.run_model(panel, "GJR-GARCH", train_size=120, test_size=2)
    own = walkforward.run(panel, lambda train, test, fold: test.assign(prediction=train["return"].std(), actual_volatility=test["target"]), **options)
    assert own.count() == test.count()


def test_gjr_recovers_its_parameters():
    rng = np.random.default_rng(3)
    v, x = 1.0, []
    for _ in range(4000):
        e = math.sqrt(v) * rng.normal()
        x.append(e)
        v = 0.05 + (0.05 + 0.1 * (e < 0)) * e * e + 0.85 * v
    got = gjr.fit(np.array(x) / 100)
    assert got.converged and got.beta == pytest.approx(0.85, abs=0.06) and got.gamma == pytest.approx(0.1, abs=0.06)
    assert got.forecast_variance > 0 and len(got.variance) == 4000
    with pytest.raises(ValueError):
        gjr.fit(np.zeros(10))


def test_hmm_separates_regimes():
    rng = np.random.default_rng(5)
    state = np.repeat([0, 1, 0, 1], 100)
    x = rng.normal(0, np.where(state, 3.0, 0.5))[:, None]
    m = hmm.fit(x, hmm.Config(n_components=2))
    found = m.filter(x).argmax(axis=1)
    assert max((found == state).mean(), (found != state).mean()) > 0.85
    assert np.allclose(m.filter(x).sum(axis=1), 1)
    np.testing.assert_allclose(np.vstack([m.filter(x[:-1]), m.filter(x[-1:], m.filter(x[:-1])[-1])]), m.filter(x), atol=1e-9)


def test_hmm_keeps_a_state_that_only_the_last_row_is_in():
    x = np.append(np.random.default_rng(3).normal(0, 1, 99), 80.0)[:, None]
    m = hmm.fit(x, hmm.Config(n_components=2))
    assert np.allclose(m.transition.sum(axis=1), 1)
    for got in (m.filter(x), m.filter_after_training(np.array([[0.1], [-0.2], [500.0], [0.0]]))):
        assert np.allclose(got.sum(axis=1), 1)


def test_boosting_fits_and_ranks_features():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    y = np.where(x[:, 1] > 0, 2.0, -1.0) + 0.1 * x[:, 0]
    m = boost.fit(x, y, boost.Config(n_estimators=40, max_depth=3))
    assert np.abs(m.predict(x) - y).mean() < 0.05 and m.importance().argmax() == 1 and m.importance().sum() == pytest.approx(1)


def test_diebold_mariano_against_numpy(spark):
    rng = np.random.default_rng(7)
    a, f, g = np.abs(rng.normal(1, 0.2, (3, 150)))
    df = spark.createDataFrame(pd.DataFrame({"timestamp": range(150), "actual": a, "f": f, "g": g}))
    got = evaluation.diebold_mariano_test(df, forecast_a="f", forecast_b="g").first()
    d = (a - f) ** 2 - (a - g) ** 2
    c, lag = d - d.mean(), 5
    lrv = (c * c).mean() + 2 * sum((1 - k / (lag + 1)) * (c[k:] * c[:-k]).mean() for k in range(1, lag + 1))
    assert got.lag == lag and got.statistic == pytest.approx(d.mean() / math.sqrt(lrv / 150), rel=1e-9)
    assert got.p_value == pytest.approx(math.erfc(abs(got.statistic) / math.sqrt(2)), rel=1e-6)


def test_bootstrap_and_confidence_sets():
    rng = np.random.default_rng(8)
    x = rng.normal(0.1, 1, 200)
    r = resampling.bootstrap_confidence_interval(x, n_bootstrap=300)
    assert r.lower < r.estimate < r.upper and r.as_dict()["observations"] == 200
    assert resampling.bootstrap_metric(np.abs(x) + 1, np.abs(x) + 1.1, metric="qlike", n_bootstrap=200).estimate > 0
    losses = np.abs(rng.normal(0, 1, (120, 3))) + np.array([0, 0, 2.0])
    for f in (resampling.model_confidence_set, resampling.model_confidence_set_by_level):
        got = f(losses, ["a", "b", "bad"], n_bootstrap=200)
        assert "bad" in got.eliminated_models and set(got.included_models) | set(got.eliminated_models) == {"a", "b", "bad"}
    with pytest.raises(resampling.ResamplingError):
        resampling.bootstrap_confidence_interval([1.0], n_bootstrap=200)


def test_risk_against_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 0.01, 500)
    df = spark.createDataFrame(pd.DataFrame({"timestamp": range(500), "asset_id": "A", "return": x, "forecast_volatility": 0.01, "simulated_return": x}))
    q = np.quantile(x, 0.05)
    es = risk.calculate_es_95(df).first()
    assert es.value_at_risk == pytest.approx(-q) and es.expected_shortfall == pytest.approx(-x[x <= q].mean()) and es.tail_count == (x <= q).sum()
    draws = risk.filtered_historical_simulation(df, 0.012, n_simulations=2000)
    assert draws.count() == 2000
    assert sorted(r.simulated_return for r in draws.collect()) == sorted(r.simulated_return for r in risk.filtered_historical_simulation(df.repartition(3), 0.012, n_simulations=2000).collect())
    with pytest.raises(risk.RiskError):
        risk.filtered_historical_simulation(df.limit(50), 0.012)
    bt = df.withColumn("actual_return", F.col("return")).withColumn("var_loss", F.lit(-float(q)))
    k = risk.kupiec_95(bt).first()
    n, e = 500, int((x <= q).sum())
    lr = -2 * (e * math.log(0.05) + (n - e) * math.log(0.95) - e * math.log(e / n) - (n - e) * math.log(1 - e / n))
    assert k.exception_count == e and k.lr_uc == pytest.approx(max(lr, 0), abs=1e-9) and k.p_value == pytest.approx(math.erfc(math.sqrt(max(lr, 0) / 2)), abs=1e-6)
    none = risk.christoffersen_95(bt.withColumn("var_loss", F.lit(9.0))).first()
    assert (none.n01, none.n10, none.n11, none.lr_ind) == (0, 0, 0, 0.0)


def test_portfolio_limits_and_costs(spark):
    now = spark.createDataFrame([("A", 0.9), ("B", -2.0)], "asset_id string, target_weight double")
    before = spark.createDataFrame([("A", 0.5), ("C", 0.3)], "asset_id string, target_weight double")
    limited = portfolio.apply_position_limits(now, max_position=0.8)
    assert {r.asset_id: r.target_weight for r in limited.collect()} == {"A": 0.8, "B": -0.8}
    out, turnover = portfolio.apply_constraints(now, max_position=0.8, previous=before, max_turnover=0.2)
    assert turnover.first().turnover == pytest.approx(0.2) and portfolio.validate_constraints(out, max_position=0.8, previous=before, max_turnover=0.2)
    assert {r.asset_id for r in portfolio.apply_turnover_limit(now, before, max_turnover=0.2, compat=True).collect()} == {"A", "B"}
    days = spark.createDataFrame([("p", DAY + dt.timedelta(days=k), a, w * (-1) ** k) for k in range(5) for a, w in (("A", 0.9), ("B", 0.3))], "portfolio_id string, timestamp timestamp, asset_id string, target_weight double")
    held = portfolio.sequential_constraints(days, max_position=0.8, max_turnover=0.2)
    assert held.agg(F.max("turnover"), F.max(F.abs("weight"))).first()[0] <= 0.2 + 1e-12
    perf = portfolio.calculate_performance(spark.createDataFrame([(k, r) for k, r in enumerate([-0.1, 0.05, -0.2, 0.1])], "timestamp long, portfolio_return double")).first()
    wealth = np.cumprod(1 + np.array([-0.1, 0.05, -0.2, 0.1]))
    assert perf.total_return == pytest.approx(wealth[-1] - 1) and perf.max_drawdown == pytest.approx((wealth / np.maximum.accumulate(wealth) - 1).min())
    with pytest.raises(portfolio.PortfolioError):
        portfolio.calculate_cost_sensitivity(now, cost_rates=(0.1, 0.1))


def test_stress_handles_empty_scenarios(spark, panel):
    df = panel.select("timestamp", "asset_id", "return", F.col("realized_volatility").alias("volatility"))
    sc = stress.build_stress_scenarios(df, historical_windows=[("early", "2024-01-01", "2024-01-10")])
    names = stress.scenario_names(spark, ["early", "high_volatility", "none"])
    got = {r.scenario: r for r in stress.analyze_stress_results(stress.run_stress_scenarios(sc, names)).collect()}
    assert got["none"].observation_count == 0 and got["none"].total_return is None and got["early"].observation_count == 20
    deep = stress.identify_prolonged_drawdowns(df.withColumn("return", F.when(F.dayofmonth("timestamp").between(10, 16), -0.05).otherwise(0.0)), minimum_duration=3)
    assert deep.agg(F.min("duration")).first()[0] >= 3
    with pytest.raises(stress.StressError):
        stress.calculate_stress_changes(stress.run_stress_scenarios(sc), reference_scenario="none")


def test_grouped_models(spark, panel):
    from voltrace.operators import models

    fit = models.fit_gjr_garch(panel).collect()
    assert {r.asset_id for r in fit} == {"A", "B"} and all(r.observations == 160 and r.forecast_volatility > 0 for r in fit)
    short = models.fit_gjr_garch(panel.filter("timestamp < '2024-01-10'")).collect()
    assert not any(r.converged for r in short)
    assert models.conditional_volatility(panel).filter("conditional_volatility > 0").count() == 320
    regimes = models.predict_regimes(models.fit_hmm(panel, ["return", "realized_volatility"], config=hmm.Config(n_components=2, n_iter=30)))
    assert models.simplex_violations(regimes).first().n == 0 and {r.regime for r in regimes.select("regime").distinct().collect()} <= {0, 1}
    trees = models.PooledTrees(n_estimators=3, max_depth=2)
    assert trees.fit_predict(panel, feature_columns=["return", "realized_volatility"]).count() == 320
    assert [r.feature for r in trees.feature_importance(spark).collect()][0] == "realized_volatility"
    joined = panel.join(regimes.select("asset_id", "timestamp", "regime_probability_0", "regime_probability_1"), ["asset_id", "timestamp"])
    assert models.PooledRegimeTrees(n_estimators=2, max_depth=2).fit(joined, feature_columns=["return"]).predict(joined).columns[-1] == "regime_xgboost_forecast"
    with pytest.raises(models.ModelError):
        models.PooledRegimeTrees().fit(joined.withColumn("regime_probability_0", F.lit(0.9)))
    z = risk.standardized_returns(panel.withColumn("forecast_volatility", F.lit(0.01)), by=("asset_id",))
    draws = models.simulate_by_group(z, panel.select("asset_id").distinct().withColumn("forecast_volatility", F.lit(0.02)), n_simulations=50)
    assert draws.count() == 100


def test_catalog_is_complete(spark):
    from voltrace.plans import catalog, more  # noqa: F401

    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 80


def test_an_asset_that_leaves_is_sold(spark):
    import datetime as dt

    from voltrace.operators import portfolio

    days = [dt.datetime(2024, 1, d) for d in (1, 2, 3, 4)]
    rows = [(days[0], "A", 0.5), (days[0], "B", 0.5), (days[1], "A", 0.7), (days[2], "A", 0.7), (days[2], "B", 0.2), (days[3], "A", 0.0)]
    w = spark.createDataFrame(rows, "timestamp timestamp, asset_id string, weight double")
    got = {r.timestamp.day: round(r.turnover, 9) for r in portfolio.turnover_by_time(w).collect()}
    assert got == {1: 1.0, 2: 0.7, 3: 0.2, 4: 0.9}
    assert portfolio.turnover_by_time(w.limit(0)).count() == 0


def test_repeated_keys_are_refused(spark):
    import datetime as dt

    import pytest

    from voltrace.operators import portfolio

    day = dt.datetime(2024, 1, 1)
    r = spark.createDataFrame([(day, "a", 0.1), (day, "B", 0.2)], "timestamp timestamp, asset_id string, return double")
    w = spark.createDataFrame([(day, "A", 1.0), (day, "B", 0.5)], "timestamp timestamp, asset_id string, weight double")
    assert [round(x.portfolio_return, 9) for x in portfolio.calculate_portfolio_returns(r, w).collect()] == [0.2]
    with pytest.raises(Exception, match="repeated"):
        portfolio.calculate_portfolio_returns(r, w.union(w)).collect()


def test_json_artifacts_are_never_cut(spark, tmp_path):
    import pytest

    from voltrace.sources import contract, files

    files.save_json_artifact({"t": spark.range(3)}, f"{tmp_path}/a.json")
    with pytest.raises(contract.ContractError):
        files.save_json_artifact({"t": spark.range(files.JSON_ROWS + 1)}, f"{tmp_path}/b.json")


def test_full_pages_that_cannot_be_split_are_refused():
    import datetime as dt

    import pytest

    from voltrace.sources import market_api

    page = '{"values": [{"datetime": "2024-01-01 00:00:00"}, {"datetime": "2024-01-01 00:00:01"}]}'
    client = market_api.Client("http://x", get=lambda url: (200, page), gap=0, page_rows=2)
    with pytest.raises(market_api.MarketApiError, match="full page"):
        list(client.fetch("A", "1min", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 4)))


def test_positions_are_numbered_by_parts(spark):
    from voltrace.runtime import numbered

    df = spark.createDataFrame([(None if i % 50 == 0 else i % 7, i) for i in range(400)], "a int, b long").repartition(6)
    got = sorted((r.position, r.a is not None, r.a, r.b) for r in numbered(df, "a", "b").collect())
    assert [x[0] for x in got] == list(range(400))
    assert [x[1:] for x in got] == sorted((x[1:] for x in got), key=lambda x: (x[0], x[1] or 0, x[2]))
    assert numbered(df.limit(0), "a", "b").count() == 0
    split = walkforward.create_fold(df.withColumnRenamed("b", "timestamp"), fold_id=2, train_indices=[0, 3, 5], test_indices=[9, 8])
    assert sorted((r.timestamp, r.role) for r in split.collect()) == [(0, "train"), (3, "train"), (5, "train"), (8, "test"), (9, "test")]
