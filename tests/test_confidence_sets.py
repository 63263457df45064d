import hashlib
import math

import numpy as np
import pytest

from voltrace.operators import resampling


def brute(x, names, alpha, replications, block=None, seed=42):
    """The rounds on one array of losses, with the hashed block starts."""
    n = len(x)
    block = min(n, block or max(1, math.ceil(math.sqrt(n))))
    starts = [[int(hashlib.md5(f"{seed}:{b}:{r}".encode()).hexdigest()[:12], 16) % (n - block + 1) for r in range(-(-n // block))] for b in range(replications)]
    index = [np.concatenate([np.arange(s, s + block) for s in row])[:n] for row in starts]
    active, out, p = list(range(len(names))), {}, 1.0
    while len(active) > 1:
        part = x[:, active]
        i, j = np.triu_indices(len(active), 1)
        d = part[:, i] - part[:, j]
        se = np.sqrt(np.maximum(resampling.bartlett_lrv(d, min(n - 1, max(1, math.isqrt(n)))), np.finfo(float).eps) / n)
        observed = (np.abs(d.mean(axis=0)) / se).max()
        draws = np.array([(np.abs((d - d.mean(axis=0))[k].mean(axis=0)) / se).max() for k in index])
        p = (1 + (draws >= observed).sum()) / (replications + 1)
        if p > alpha:
            break
        out[names[active.pop(int(part.mean(axis=0).argmax()))]] = p
    return sorted((m, m not in out, round(out.get(m, p), 9)) for m in names)


@pytest.mark.parametrize("block", [None, 7])
def test_rounds_against_arrays(spark, monkeypatch, block):
    monkeypatch.setattr(resampling, "PREFIX_ROWS", 32)
    rng = np.random.default_rng(3)
    names, groups = ["a", "b", "c"], {}
    for key, n, shift in (("hot", 400, (0.0, 0.4, 0.05)), ("same", 90, (0.0, 0.0, 0.0)), (None, 60, (0.5, 0.0, 1.0)), ("tiny", 2, (0.0, 1.0, 2.0))):
        noise = np.cumsum(rng.normal(0, 0.1, n))[:, None] + rng.normal(0, 1, (n, 3))
        groups[key] = noise + np.array(shift)
    rows = [(k, t, *map(float, v)) for k, x in groups.items() for t, v in enumerate(x)] + [("hot", 1000, None, 1.0, 1.0), ("one", 0, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "g string, t long, a double, b double, c double").repartition(4)
    got = {}
    for r in resampling.distributed_confidence_set(df, names, ("g",), order=("t",), n_bootstrap=200, block_length=block).collect():
        got.setdefault(r.g, []).append((r.model, r.included, round(r.p_value, 9)))
    want = {k: brute(x, names, 0.1, 200, block) for k, x in groups.items()}
    assert {k: sorted(v) for k, v in got.items()} == want and {i for v in want.values() for _, i, _ in v} == {True, False}


def test_without_groups_and_bad_input(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (50, 2)) + np.array([0.0, 2.0])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "t long, a double, b double")
    got = sorted((r.model, r.included, round(r.p_value, 9)) for r in resampling.distributed_confidence_set(df, ["a", "b"], order=("t",), n_bootstrap=100).collect())
    assert got == brute(x, ["a", "b"], 0.1, 100)
    with pytest.raises(resampling.ResamplingError):
        resampling.distributed_confidence_set(df, ["a", "a"], order=("t",))
