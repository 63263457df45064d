import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltrace.operators import models, walkforward
from voltrace.operators.kernels import gjr, hmm


@pytest.fixture(autouse=True)
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def panel(spark, n=90, gaps=True, seed=1):
    rng = random.Random(seed)
    rows = [(f"2024-{1 + t // 28:02}-{1 + t % 28:02} 00:00:00", a, rng.gauss(0.001, 0.02), 0.01 + rng.random() / 50) for t in range(n) for a in "ABC" if not gaps or a == "A" or rng.random() < (0.6 if a == "B" else 0.15)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "timestamp string, asset_id string, return double, target double").withColumn("timestamp", F.to_timestamp("timestamp")).repartition(3)


def as_rows(df):
    return {(r.fold_id, r.timestamp, r.asset_id): (r.prediction, r.actual_volatility) for r in df.collect()}


@pytest.mark.parametrize(("train", "test", "step", "purge"), [(20, 1, 1, 0), (7, 3, 5, 0), (7, 3, 2, 2), (1, 1, 1, 0), (30, 10, None, 5)])
def test_rolling_ewma_against_exploded_folds(spark, train, test, step, purge):
    df = panel(spark)
    rows = walkforward.assign_folds(df, train_size=train, test_size=test, step_size=step, purge=purge).withColumn("fold_id", F.col("fold_id").cast("int"))
    want = as_rows(walkforward.predict_ewma(rows, "target"))
    got = as_rows(walkforward.rolling_ewma(df, "target", train_size=train, test_size=test, step_size=step, purge=purge))
    assert len(want) > 50 and got.keys() == want.keys()
    assert all(math.isclose(got[k][0], want[k][0], rel_tol=1e-10) and got[k][1] == want[k][1] for k in want)


def test_rolling_ewma_edges(spark):
    df = panel(spark, 10)
    assert walkforward.rolling_ewma(df, "target", train_size=50).count() == 0 and walkforward.rolling_ewma(df.limit(0), "target", train_size=3).count() == 0
    with pytest.raises(walkforward.WalkForwardError):
        walkforward.rolling_ewma(df, "target", train_size=3, purge=3)
    expanding = walkforward.run_model(df, "EWMA", train_size=3, test_size=1, expanding=True)
    assert expanding.filter("asset_id = 'A'").count() == 7


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(4)
    for n in (40, 128, 129, 300):
        x = rng.normal(0.1, 1.5, n)
        for q in rng.normal(0, 1, (4, 5)):
            # Two windows at once, the second cut to 35 rows by its mask.
            both, held = np.column_stack([x, x]), np.column_stack([np.ones(n), np.arange(n) < 35])

            def f(q):
                return gjr.loss(np.array([q, q]), both, held, np.array([1.3, 1.3]), np.array([2.0, 2.0]))

            (value, cut), g = f(q)
            for k in range(2):
                numeric = [(f(q + h)[0][k] - f(q - h)[0][k]) / 2e-6 for h in np.eye(5) * 1e-6]
                assert np.allclose(g[k], numeric, rtol=1e-4, atol=1e-4)
            assert math.isclose(cut, gjr.loss(q[None], x[:35, None], np.ones((35, 1)), np.array([1.3]), np.array([2.0]))[0][0])
            mu, omega, alpha, gamma, beta = gjr._unpack(q, 2.0)
            v, total = 1.3, 0.0
            for r in x:
                total += math.log(v) + (r - mu) ** 2 / v
                v = omega + (alpha + gamma * (r < mu)) * (r - mu) ** 2 + beta * v
            assert math.isclose(value, 0.5 * (total + n * math.log(2 * math.pi)), rel_tol=1e-10)


def test_neighbouring_folds_fit_as_well_as_alone(spark, monkeypatch):
    """Log-likelihoods of fits among neighbours are no lower than those of fits alone (but for 0.001); all folds have forecasts."""
    rng = np.random.default_rng(2)
    x = rng.standard_t(4, 170) * 0.01
    windows = [x[i:i + 120] for i in range(40)] + [x[:10], x[:60]]
    together = gjr.fits(windows)
    assert together[40] is None and all(f.converged for f in together[:40])
    assert all(f.log_likelihood > gjr.fit(w).log_likelihood - 1e-3 for f, w in zip(together[:40:4], windows[:40:4], strict=True))
    monkeypatch.setattr(walkforward, "NEIGHBOURS", 8)
    df = panel(spark, 70, gaps=False)
    got = walkforward.garch_features(df, train_size=40, test_size=1, step_size=1)
    forecasts = walkforward.garch_features(df, train_size=40, test_size=1, step_size=1, forecasts_only=True)
    rows = walkforward.assign_folds(df, train_size=40, test_size=1, step_size=1)
    keys = ["fold_id", "role", "timestamp", "asset_id"]
    wanted = {(r.fold_id, r.role, r.timestamp, r.asset_id) for r in rows.select(*keys).collect()}
    found = got.collect()
    assert len(found) == len(wanted) and {(r.fold_id, r.role, r.timestamp, r.asset_id) for r in found} == wanted
    assert sorted(map(tuple, forecasts.collect())) == sorted(tuple(r) for r in found if r.role == "test") and all(r.garch_forecast > 0 for r in found)
    short = walkforward.garch_features(df, train_size=10, test_size=1, step_size=7, forecasts_only=True).collect()
    assert short and all(r.garch_forecast is None and not r.garch_converged for r in short)


def test_garch_variance_for_given_parameters(spark):
    df = panel(spark, 80)
    given = {"A": (0.001, 2e-5, 0.05, 0.1, 0.8), "B": (0.0, 1e-5, 0.1, 0.0, 0.0)}
    params = spark.createDataFrame([(k, *v) for k, v in given.items()], "asset_id string, mu double, omega double, alpha double, gamma double, beta double")
    got = {}
    for r in models.garch_variance(df, params).orderBy("timestamp").collect():
        got.setdefault(r.asset_id, []).append(r.conditional_variance)
    assert got.keys() == given.keys()
    for a, (mu, omega, alpha, gamma, beta) in given.items():
        x = np.array([r["return"] for r in df.filter(F.col("asset_id") == a).orderBy("timestamp").collect()])
        want = gjr._variances([mu, omega, alpha, gamma, beta], x.tolist(), float(np.var(x)))[:-1]
        assert np.allclose(got[a], want, rtol=1e-9)


@pytest.mark.parametrize("state", [None, np.array([0.2, 0.5, 0.3])])
def test_regime_filter_by_parts(spark, state):
    rng = np.random.default_rng(7)
    n = 700
    x = np.column_stack([rng.normal(0, 1, n) + np.repeat(rng.integers(0, 3, 70) * 4, 10), rng.normal(0, 1, n)])
    x[50] = 80.0  # far from every state
    spread = rng.random((3, 2, 2)) * 0.2
    m = hmm.Model(hmm.Config(), np.array([1.0, 0.0]), np.array([2.0, 1.0]), np.array([0.6, 0.3, 0.1]), np.array([[0.9, 0.1, 0.0], [0.05, 0.9, 0.05], [0.0, 0.2, 0.8]]),
                  np.array([[-0.5, 0.0], [1.5, 0.1], [3.5, -0.1]]), np.array([np.eye(2) + (s + s.T) for s in spread]))
    rows = [("hot", i, *map(float, v)) for i, v in enumerate(x)] + [(None, i, *map(float, v)) for i, v in enumerate(x[:9])] + [("hot", n, float("nan"), 1.0), ("one", 0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "asset_id string, timestamp long, u double, v double").repartition(4)
    got = {}
    for r in models.filter_regimes(df, ["u", "v"], m, state=state).orderBy("timestamp").collect():
        got.setdefault(r.asset_id, []).append([r[f"regime_probability_{k}"] for k in range(3)])
    for key, values in (("hot", x), (None, x[:9]), ("one", np.zeros((1, 2)))):
        assert np.allclose(got[key], m.filter(values, state), atol=1e-9)
