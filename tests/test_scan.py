import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltrace.operators import asof, ewma, portfolio, quantiles, scan


@pytest.fixture(autouse=True)
def many_parts(spark):
    """Small tables too are dealt over several parts."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def panel(spark, n=3000, seed=1):
    """A hot asset with most rows, small ones, a null one; shuffled."""
    rng = random.Random(seed)
    rows = [("hot" if i % 10 else rng.choice(["a", "b", None]), i, rng.gauss(0, 0.02)) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "asset_id string, t long, r double").repartition(5)


def series(rows):
    out = {}
    for a, t, r in sorted(rows, key=lambda x: x[1]):
        out.setdefault(a, []).append((t, r))
    return out


def test_positions_and_previous(spark):
    rows, df = panel(spark)
    want = {(a, t): (i, s[i - 1][1] if i else None) for a, s in series(rows).items() for i, (t, _) in enumerate(s)}
    got = {(r.asset_id, r.t): r.position for r in scan.positions(df, ["asset_id"], ["t"]).collect()}
    assert got == {k: v[0] for k, v in want.items()}
    assert {(r.asset_id, r.t): r.before for r in scan.previous(df, "r", ["asset_id"], ["t"], "before").collect()} == {k: v[1] for k, v in want.items()}
    parts = scan.in_parts(df, ["asset_id"], ["t"])
    assert parts.filter("asset_id = 'hot'").select(scan.PART).distinct().count() > 1
    assert scan.positions(df.limit(0), ["asset_id"], ["t"]).count() == 0


@pytest.mark.parametrize("decay", [0.0, 0.01, 0.94, 1 - 1e-9])
@pytest.mark.parametrize("exclusive", [False, True])
def test_decayed_sums(spark, monkeypatch, decay, exclusive):
    monkeypatch.setattr(scan, "BLOCK_ROWS", 32)  # several levels
    rows, df = panel(spark, 1500)
    want = {}
    for a, s in series(rows).items():
        v = 0.0
        for t, r in s:
            if exclusive:
                want[a, t] = v
            v = decay * v + r * r
            if not exclusive:
                want[a, t] = v
    made = scan.decayed_sum(scan.positions(df, ["asset_id"], ["t"]), F.col("r") * F.col("r"), decay, ["asset_id"], name="s", exclusive=exclusive)
    got = {(r.asset_id, r.t): r.s for r in made.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-18) for k in want)


def test_decays_by_group(spark):
    rows, df = panel(spark, 900)
    decays = {"hot": 0.97, "a": 0.0, "b": 0.3, None: 0.9}
    df = df.withColumn("d", F.when(F.col("asset_id").isNull(), 0.9).otherwise(F.create_map(*(F.lit(x) for k, v in decays.items() if k for x in (k, v)))[F.col("asset_id")]))
    got = {(r.asset_id, r.t): r.s for r in scan.decayed_sum(scan.positions(df, ["asset_id"], ["t"]), F.col("r"), "d", ["asset_id"], name="s").collect()}
    for a, s in series(rows).items():
        v = 0.0
        for t, r in s:
            v = decays[a] * v + r
            assert math.isclose(got[a, t], v, rel_tol=1e-9, abs_tol=1e-15)
    with pytest.raises(ValueError):
        scan.decayed_sum(df, F.col("r"), 1.0, ["asset_id"], name="s", position="t")


def test_ewma_series(spark):
    rows, df = panel(spark, 2000)
    got = {(r.asset_id, r.t): r.variance for r in ewma.transform(df, time="t", value="r").collect()}
    for a, s in series(rows).items():
        v = s[0][1] ** 2
        for i, (t, _) in enumerate(s):
            v = v if not i else 0.94 * v + 0.06 * s[i - 1][1] ** 2
            assert math.isclose(got[a, t], v, rel_tol=1e-10)
    plan = ewma.transform(df, time="t", value="r")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("from_one", [False, True])
def test_wealth(spark, from_one):
    rng = random.Random(3)
    rows, _ = panel(spark, 1200)
    # Losses of more than everything turn the wealth negative, and its order around; one null return.
    rows = [(a, t, None if t == 7 else -2.5 if t in (300, 301, 900) else 20 * r + rng.random() / 100) for a, t, r in rows]
    df = spark.createDataFrame(rows, "asset_id string, t long, r double").repartition(4)
    got = {(r.asset_id, r.t): (r.wealth, r.peak, r.drawdown) for r in portfolio.wealth_columns(df, "r", ("t",), ("asset_id",), from_one=from_one).collect()}
    for a, s in series(rows).items():
        w, peak = 1.0, 1.0 if from_one else -math.inf
        for t, r in s:
            w *= 1 + (r or 0)
            peak = max(peak, w)
            assert np.allclose(got[a, t], (w, peak, w / peak - 1), rtol=1e-8)
    one = portfolio.wealth_columns(df.limit(0), "r", ("t",), ())
    assert one.count() == 0


@pytest.mark.parametrize("bound", [16, 300, 4096])
def test_exact_quantiles(spark, bound):
    rng = random.Random(5)
    rows = [("hot", rng.gauss(0, 1) * 10 ** rng.randrange(-30, 30)) for _ in range(4000)] + [("ties", rng.choice([1.0, 1.0, 1.0, 2.0, -3.0])) for _ in range(1500)]
    rows += [("same", 7.5)] * 700 + [(None, float(i)) for i in range(300)] + [("few", x) for x in (3.0, 1.0, None, float("nan"), 2.0)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    probs = [0.0, 0.01, 0.05, 0.5, 0.5, 0.999, 1.0]
    values = {}
    for g, x in rows:
        if x is not None and not math.isnan(x):
            values.setdefault(g, []).append(x)
    got = {r.g: (r.q, r.n) for r in quantiles.exact_quantiles(df, "x", probs, ["g"], bound=bound).collect()}
    assert got.keys() == values.keys()
    for g, xs in values.items():
        assert got[g][1] == len(xs) and np.allclose(got[g][0], np.quantile(xs, probs), rtol=1e-12, atol=0)
    every = [x for xs in values.values() for x in xs]
    whole = quantiles.exact_quantiles(df, "x", probs, bound=bound).collect()
    assert len(whole) == 1 and whole[0].n == len(every) and np.allclose(whole[0].q, np.quantile(every, probs), rtol=1e-12, atol=0)
    assert quantiles.exact_quantiles(df.limit(0), "x", probs, ["g"], bound=bound).count() == 0


def brute_asof(left, right, forward, strict, tolerance=None):
    out = []
    for k, t, w in left:
        ok = [(u, v) for j, u, v in right if None not in (k, t, j, u) and j == k and ((u > t or u == t and not strict) if forward else (u < t or u == t and not strict))]
        ok = [x for x in ok if tolerance is None or abs((x[0] - t).total_seconds()) <= tolerance] if not (tolerance and ok and abs(((min(ok) if forward else max(ok))[0] - t).total_seconds()) > tolerance) else []
        out.append((k, t, w, *((min(ok) if forward else max(ok)) if ok else (None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("strict", [True, False])
def test_asof(spark, forward, strict):
    rng = random.Random(9)
    day = dt.datetime(2024, 1, 1)
    times = [day + dt.timedelta(minutes=rng.randrange(4000)) for _ in range(600)]
    keys = ["hot"] * 20 + ["a", "b", None]
    left = [(rng.choice(keys), rng.choice([*times, None] if i % 50 == 0 else times), float(i // 2)) for i in range(500)]
    # The hot asset's right rows lie in two distant bursts, so parts between them are empty; ties in time; an asset without any.
    right = [("hot", rng.choice(times[:40] + [day + dt.timedelta(minutes=3990 + rng.randrange(4))]), float(rng.randrange(9))) for _ in range(200)] + [("a", rng.choice(times), 1.0) for _ in range(9)] + [(None, day, 1.0), ("b", None, 2.0)]
    schema = "asset_id string, timestamp timestamp, weight double"
    lf, rf = spark.createDataFrame(left, schema).repartition(4), spark.createDataFrame(right, schema.replace("weight", "x")).repartition(4)
    options = {"direction": "forward" if forward else "backward", "strict": strict}
    want = brute_asof(left, right, forward, strict)
    assert sorted(map(tuple, asof.asof_join(lf, rf, how="left", **options).collect()), key=str) == want
    assert sorted(map(tuple, asof.asof_join(lf, rf, **options).collect()), key=str) == [w for w in want if w[3] is not None]
    near = asof.asof_join(lf, rf, how="left", tolerance=F.expr("INTERVAL 5 MINUTES"), **options)
    assert sorted(map(tuple, near.collect()), key=str) == brute_asof(left, right, forward, strict, 300)
    assert asof.asof_join(lf.limit(0), rf, **options).count() == 0 and asof.asof_join(lf, rf.limit(0), **options).count() == 0


def test_asof_names_and_next_returns(spark):
    lf = spark.createDataFrame([("a", 1, 0.5, 1)], "asset_id string, timestamp long, target_weight double, x int")
    rf = spark.createDataFrame([("a", 1, 9.0, 2), ("a", 3, 8.0, 3)], "asset_id string, timestamp long, return double, x int")
    assert asof.asof_join(lf, rf).columns == ["asset_id", "timestamp", "target_weight", "x", "matched_timestamp", "return", "x_right"]
    assert [tuple(r) for r in asof.next_returns(lf, rf).collect()] == [(3, "a", 0.5, 8.0)]
    with pytest.raises(ValueError):
        asof.asof_join(lf, rf, direction="nearest")
