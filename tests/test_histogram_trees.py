import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltrace.operators import histogram_trees
from voltrace.operators.kernels import boost


def table(spark, x, y, extra=()):
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))] + list(extra)
    return spark.createDataFrame(rows, "k long, a double, b double, c double, target double").repartition(4)


@pytest.mark.parametrize("options", [{}, {"reg_alpha": 2.0, "min_child_weight": 5.0}, {"gamma": 3.0, "reg_lambda": 0.5}, {"colsample_bytree": 0.6}])
def test_agrees_with_exact_trees_on_binned_data(spark, options):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, (400, 3))
    y = 3.0 * (x[:, 0] > 4) + np.sin(x[:, 1]) + rng.normal(0, 0.2, 400)
    config = boost.Config(n_estimators=3, max_depth=3, **options)
    df = table(spark, x, y, [(1000, None, 1.0, 1.0, 1.0), (1001, 1.0, float("nan"), 1.0, 1.0)])
    model = histogram_trees.fit(df, ["a", "b", "c"], key=("k",), config=config)
    got = {r.k: r.forecast for r in model.predict(df, least=None).collect()}
    if options.get("colsample_bytree") is None:
        want = boost.fit(x, y, config).predict(x)
        assert all(math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-9) for i in range(400))
        assert np.allclose(dict(model.importance())["a"], boost.fit(x, y, config).importance()[0])
    else:
        assert all(len({f for f in t[0] if f >= 0}) <= 2 for t in model.booster.trees) and np.mean((np.array([got[i] for i in range(400)]) - y) ** 2) < y.var()
    assert got[1000] is None and got[1001] is None


def test_draws_of_rows_repeat_and_empty_tables(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (600, 3))
    y = x[:, 0] * 2 + rng.normal(0, 0.1, 600)
    config = boost.Config(n_estimators=4, max_depth=3, subsample=0.5)
    df = table(spark, x, y)
    first, again = (histogram_trees.fit(d, ["a", "b", "c"], key=("k",), config=config, bins=16) for d in (df, df.repartition(2)))
    for s, t in zip(first.booster.trees, again.booster.trees, strict=True):
        assert all(np.allclose(a, b) for a, b in zip(s, t, strict=True))
    assert first.importance()[0][0] == "a" and max(len(e) for e in first.edges) == 15
    small = boost.fit(x, y, boost.Config(n_estimators=20, max_depth=3, subsample=0.5, colsample_bytree=0.7, reg_alpha=0.1))
    assert np.mean((small.predict(x) - y) ** 2) < 0.3 * y.var()
    with pytest.raises(ValueError):
        histogram_trees.fit(df.limit(0), ["a"], key=("k",))
    one = histogram_trees.fit(df.filter(F.col("k") == 3), ["a"], key=("k",), config=boost.Config(n_estimators=2))
    assert math.isclose(one.predict(df.filter(F.col("k") == 3), least=None).first().forecast, y[3])
