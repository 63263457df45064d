"""Bootstrap intervals and model confidence sets.

Two forms of bootstrap: ``hashed_bootstrap`` draws by hashed indices and joins,
so values of any number stay distributed and SQL can repeat it; the array forms
use NumPy's generator on a group's values, for results of bounded size such as
a fold's losses.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrace.operators import scan
from voltrace.runtime import materialize, numbered

LEAST_REPLICATIONS = 100
#: Rows of a block of prefix sums.
PREFIX_ROWS = 4096


class ResamplingError(ValueError):
    """Too few values or replications."""


@dataclass(frozen=True)
class BootstrapResult:
    estimate: float
    lower: float
    upper: float
    standard_error: float
    confidence_level: float
    n_bootstrap: int
    observations: int

    def as_dict(self) -> dict:
        return asdict(self)


def _checked(n: int, level: float, replications: int) -> None:
    if n < 2 or replications < LEAST_REPLICATIONS or not 0 < level < 1:
        raise ResamplingError("two values, 100 replications and a level between 0 and 1 are needed")


def _interval(estimate: float, draws: np.ndarray, level: float, n: int) -> BootstrapResult:
    low, up = np.quantile(draws, [(1 - level) / 2, (1 + level) / 2])
    return BootstrapResult(float(estimate), float(low), float(up), float(draws.std(ddof=1)), level, len(draws), n)


def bootstrap_indices(n: int, statistic: Callable[[np.ndarray], float], estimate: float, *, confidence_level: float = 0.95, n_bootstrap: int = 2000, random_state: int = 42) -> BootstrapResult:
    """Percentile interval of statistic(indices) over index samples with replacement."""
    _checked(n, confidence_level, n_bootstrap)
    rng = np.random.default_rng(random_state)
    draws = np.array([statistic(rng.integers(0, n, size=n)) for _ in range(n_bootstrap)])
    return _interval(estimate, draws, confidence_level, n)


def bootstrap_confidence_interval(values, *, statistic: Callable = np.mean, **options) -> BootstrapResult:
    x = np.asarray(values, dtype=float)
    return bootstrap_indices(len(x), lambda i: float(statistic(x[i])), float(statistic(x)), **options)


_METRICS = {
    "mae": lambda a, f: np.abs(a - f).mean(),
    "rmse": lambda a, f: math.sqrt(((a - f) ** 2).mean()),
    "qlike": lambda a, f: (a / f - np.log(a / f) - 1).mean(),
}


def bootstrap_metric(actual, forecast, *, metric: str = "mae", **options) -> BootstrapResult:
    a, f = (np.asarray(x, dtype=float) for x in (actual, forecast))
    if metric not in _METRICS or len(a) != len(f):
        raise ResamplingError("a known metric and equal lengths are needed")
    m = _METRICS[metric]
    return bootstrap_indices(len(a), lambda i: float(m(a[i], f[i])), float(m(a, f)), **options)


def bootstrap_difference(values_a, values_b, **options) -> BootstrapResult:
    a, b = (np.asarray(x, dtype=float) for x in (values_a, values_b))
    if len(a) != len(b):
        raise ResamplingError("paired values are needed")
    return bootstrap_confidence_interval(a - b, **options)


def bootstrap_sharpe_ratio(returns, *, annualization_factor: float = 252.0, **options) -> BootstrapResult:
    def sharpe(x: np.ndarray) -> float:
        sd = x.std(ddof=1)
        return float(x.mean() / sd * math.sqrt(annualization_factor)) if sd > 0 else 0.0

    return bootstrap_confidence_interval(returns, statistic=sharpe, **options)


def grouped_bootstrap(df: DataFrame, column: str, by, *, statistic: Callable = np.mean, order: str = "timestamp", **options) -> DataFrame:
    """The array form for each group, groups in parallel: (by..., estimate, lower, upper, standard_error, ...)."""
    fields = "estimate double, lower double, upper double, standard_error double, confidence_level double, n_bootstrap int, observations int"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = bootstrap_confidence_interval(pdf.sort_values(order)[column].to_numpy(), statistic=statistic, **options)
        return pd.DataFrame([[*key, *r.as_dict().values()]], columns=[*by, *r.as_dict()])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return df.select(*by, order, column).groupBy(*by).applyInPandas(one, f"{kinds}, {fields}")


def hashed_bootstrap(df: DataFrame, column: str, order, *, n_bootstrap: int = 2000, confidence_level: float = 0.95, seed: int = 42, statistic: str = "mean", annualization_factor: float = 252.0) -> DataFrame:
    """One row (estimate, lower, upper, standard_error, observations) for the mean, or the annualised Sharpe ratio (0 where the deviation is none).

    Draw k of replication b takes row md5(seed:b:k) mod n. Rows are numbered by parts, not in one task; draws are
    generated where they are joined, n for each replication, and averages are aggregated on the map side.
    """
    if statistic not in ("mean", "sharpe"):
        raise ResamplingError(f"unknown statistic {statistic}")
    deviation = F.stddev_samp("x")
    value = F.avg("x") if statistic == "mean" else F.when(deviation > 0, F.avg("x") / deviation * math.sqrt(annualization_factor)).otherwise(0.0)
    rows = df.filter(F.col(column).isNotNull()).select(*order, F.col(column).cast("double").alias("x"))
    placed = numbered(rows, *order, "x", tag="bootstrap-rows").select("x", "position")
    n = rows.count()
    _checked(n, confidence_level, max(n_bootstrap, LEAST_REPLICATIONS))
    grid = df.sparkSession.range(n_bootstrap * n).select(F.floor(F.col("id") / n).alias("b"), (F.col("id") % n).alias("k"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("k").cast("string"))), 1, 12), 16, 10).cast("long") % n
    means = grid.select("b", pick.alias("position")).join(placed, "position").groupBy("b").agg(value.alias("m"))
    low, up = (1 - confidence_level) / 2, (1 + confidence_level) / 2
    stats = means.agg(F.percentile("m", F.lit(low)).alias("lower"), F.percentile("m", F.lit(up)).alias("upper"), F.stddev_samp("m").alias("standard_error"))
    return rows.agg(value.alias("estimate"), F.count(F.lit(1)).alias("observations")).crossJoin(stats)  # one row each


def hashed_bootstrap_difference(df: DataFrame, column_a: str, column_b: str, order, **options) -> DataFrame:
    """hashed_bootstrap of the paired difference a - b; rows where either is null are left out."""
    return hashed_bootstrap(df.withColumn("__difference", F.col(column_a) - F.col(column_b)), "__difference", order, **options)


# Model confidence sets ----------------------------------------------------------


def moving_block_indices(n: int, block: int, rng: np.random.Generator) -> np.ndarray:
    starts = rng.integers(0, n - block + 1, size=-(-n // block))
    return (starts[:, None] + np.arange(block)).ravel()[:n]


def bartlett_lrv(x: np.ndarray, lags: int) -> np.ndarray:
    """Long-run variance of each column."""
    c = x - x.mean(axis=0)
    out = (c * c).mean(axis=0)
    for k in range(1, min(lags, len(c) - 1) + 1):
        out = out + 2 * (1 - k / (lags + 1)) * (c[k:] * c[:-k]).mean(axis=0)
    return out


@dataclass(frozen=True)
class MCSResult:
    included_models: tuple[str, ...]
    eliminated_models: tuple[str, ...]
    p_value: float
    test_statistic: float
    n_bootstrap: int
    block_length: int
    history: tuple[tuple[str, float, float], ...]

    @property
    def is_singleton(self) -> bool:
        return len(self.included_models) == 1


def _rounds(losses: np.ndarray, names: list[str], step, keep) -> tuple[list[int], float, float, list]:
    active, history, p, stat = list(range(len(names))), [], 1.0, 0.0
    while len(active) > 1:
        stat, p, worst = step(losses[:, active])
        if keep(p):
            break
        history.append((names[active.pop(worst)], p, stat))
    return active, p, stat, history


def _pairs(k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(k, 1)


def _losses(losses, models) -> tuple[np.ndarray, list[str]]:
    x = np.asarray(losses, dtype=float)
    names = list(models) if models is not None else [f"Model_{k}" for k in range(x.shape[1])]
    if x.ndim != 2 or len(x) < 2 or len(names) != x.shape[1] or len(set(names)) != len(names) or not np.isfinite(x).all():
        raise ResamplingError("losses must be a finite matrix with one name for each column")
    return x, names


def model_confidence_set(losses, models=None, *, alpha: float = 0.1, n_bootstrap: int = 2000, block_length: int | None = None, random_state: int = 42) -> MCSResult:
    """Range statistic of studentised pairwise differences; moving-block bootstrap of centred losses; the highest mean loss goes first."""
    x, names = _losses(losses, models)
    n, rng = len(x), np.random.default_rng(random_state)
    block = block_length or max(1, math.ceil(math.sqrt(n)))

    def step(part: np.ndarray):
        i, j = _pairs(part.shape[1])
        d = part[:, i] - part[:, j]
        se = np.sqrt(np.maximum(bartlett_lrv(d, max(1, math.isqrt(n))), np.finfo(float).eps) / n)
        observed = float((np.abs(d.mean(axis=0)) / se).max())
        centred = d - d.mean(axis=0)
        draws = np.array([(np.abs(centred[moving_block_indices(n, block, rng)].mean(axis=0)) / se).max() for _ in range(n_bootstrap)])
        return observed, float((1 + (draws >= observed).sum()) / (n_bootstrap + 1)), int(part.mean(axis=0).argmax())

    active, p, stat, history = _rounds(x, names, step, lambda p: p > alpha)
    return MCSResult(tuple(names[k] for k in active), tuple(h[0] for h in history), p, stat, n_bootstrap, block, tuple(history))


mcs = model_confidence_set


def model_confidence_set_by_level(losses, models=None, *, confidence_level: float = 0.9, n_bootstrap: int = 2000, block_length: int = 5, random_state: int = 42, compat: bool = False) -> MCSResult:
    """The second variant: Bartlett weights up to block_length - 1, p = share of draws at or above the statistic, the model worst against any other goes first.

    Samples are centred on the full sample's means; compat centres each on its own, which makes every draw about 0.
    """
    x, names = _losses(losses, models)
    n, rng = len(x), np.random.default_rng(random_state)

    def step(part: np.ndarray):
        k = part.shape[1]
        i, j = _pairs(k)
        d = part[:, i] - part[:, j]
        lrv = bartlett_lrv(d, block_length - 1)
        t = np.where(lrv > 0, d.mean(axis=0) / np.sqrt(np.where(lrv > 0, lrv, 1) / n), 0.0)
        full = np.zeros((k, k))
        full[i, j], full[j, i] = t, -t
        observed, draws = float(np.abs(t).max()), np.empty(n_bootstrap)
        for b in range(n_bootstrap):
            s = d[moving_block_indices(n, block_length, rng)]
            shift = s.mean(axis=0) - (s.mean(axis=0) if compat else d.mean(axis=0))
            se = s.std(axis=0, ddof=1) / math.sqrt(n)
            draws[b] = np.where(se > 0, np.abs(shift) / np.where(se > 0, se, 1), 0.0).max()
        worst = full.max(axis=1)
        pick = int(worst.argmax()) if worst.max() > 0 else int(part.mean(axis=0).argmax())
        return observed, float((draws >= observed).mean()), pick

    active, p, stat, history = _rounds(x, names, step, lambda p: p >= 1 - confidence_level)
    return MCSResult(tuple(names[k] for k in active), tuple(h[0] for h in history), p, stat, n_bootstrap, block_length, tuple(history))


def grouped_model_confidence_set(loss_matrix: DataFrame, models: list[str], by, *, order: str = "timestamp", **options) -> DataFrame:
    """(by..., model, included, p_value): a confidence set for each group of a wide loss matrix, groups in parallel."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).dropna(subset=models)
        r = model_confidence_set(pdf[models].to_numpy(), models, **options)
        gone = {m: p for m, p, _ in r.history}
        return pd.DataFrame([[*key, m, m in r.included_models, gone.get(m, r.p_value)] for m in models], columns=[*by, "model", "included", "p_value"])

    kinds = ", ".join(f"{c} {loss_matrix.schema[c].dataType.simpleString()}" for c in by)
    return loss_matrix.select(*by, order, *models).groupBy(*by).applyInPandas(one, f"{kinds}, model string, included boolean, p_value double")


def distributed_confidence_set(loss_matrix: DataFrame, models: list[str], by=(), *, order=("timestamp",), alpha: float = 0.1, n_bootstrap: int = 2000, block_length: int | None = None, seed: int = 42) -> DataFrame:
    """(by..., model, included, p_value): model_confidence_set for groups of any size, as one plan.

    Block r of replication b starts at row md5(seed:b:r) mod (n - block + 1), so SQL can repeat it. A block's sum is the difference of two prefix sums, looked up
    by position; a replication reads 2 n / block rows, not n, and no task holds a group. Prefix sums go by blocks of positions; products of neighbouring rows, for
    the long-run variance, come from arrays of at most the root of n. All rounds use the same draws. Rows with a null loss are left out.
    """
    if len(set(models)) != len(models) or len(models) < 2 or n_bootstrap < LEAST_REPLICATIONS:
        raise ResamplingError("two distinct models and 100 replications are needed")
    m, keys = len(models), list(by)
    rows = loss_matrix.select(*keys, *order, *(F.col(x).cast("double").alias(f"l{i}") for i, x in enumerate(models))).na.drop(subset=[f"l{i}" for i in range(m)])
    losses = F.array(*(F.col(f"l{i}") for i in range(m)))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(f"l{i}") for i in range(m))).alias("mean"))
    block = F.lit(block_length) if block_length else F.greatest(F.lit(1), F.ceil(F.sqrt("n")))
    sizes = sizes.filter("n > 1").withColumn("block", F.least(block, F.col("n")).cast("long")).withColumn("lags", F.least(F.greatest(F.lit(1), F.floor(F.sqrt("n"))), F.col("n") - 1).cast("long"))
    sizes = materialize(sizes, "mcs-groups")  # a row for each group

    def grouped(df: DataFrame, small: DataFrame) -> DataFrame:
        return scan.matched(df, small, keys, "inner") if keys else df.crossJoin(F.broadcast(small))  # without groups, one row

    placed = scan.positions(rows, keys, list(order), "position", "mcs-rows")
    placed = materialize(grouped(placed.select(*keys, "position", losses.alias("loss")), sizes).withColumn("centred", F.zip_with("loss", "mean", lambda a, b: a - b)), "mcs-placed")
    # Prefix sums by blocks of positions: within a block by a window, before it by a window over blocks' sums.
    chunk = F.floor(F.col("position") / PREFIX_ROWS)
    inside = Window.partitionBy(*keys, "chunk").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("chunk", chunk).select(*keys, "chunk", "position", *(F.sum(F.col("centred")[i]).over(inside).alias(f"p{i}") for i in range(m)))
    ends = placed.withColumn("chunk", chunk).groupBy(*keys, "chunk").agg(*(F.sum(F.col("centred")[i]).alias(f"e{i}") for i in range(m)))
    ahead = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "chunk", *(F.coalesce(F.sum(f"e{i}").over(ahead), F.lit(0.0)).alias(f"e{i}") for i in range(m)))
    prefix = scan.matched(summed, ends, [*keys, "chunk"]).select(*keys, (F.col("position") + 1).alias("at"), F.array(*(F.col(f"p{i}") + F.col(f"e{i}") for i in range(m))).alias("prefix"))
    # Draws: each block asks for the prefix sums at its end and, negated, at its start.
    count = F.ceil(F.col("n") / F.col("block")).cast("long")
    draws = sizes.select(*keys, "n", "block", F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap - 1))).alias("b"), count.alias("count")).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("r").cast("string"))), 1, 12), 16, 10).cast("long") % (F.col("n") - F.col("block") + 1)
    length = F.least(F.col("block"), F.col("n") - F.col("r") * F.col("block"))
    asked = draws.withColumn("start", start).select(*keys, "b", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(-1.0).alias("sign")), F.struct((F.col("start") + length).alias("at"), F.lit(1.0).alias("sign")))).alias("q")).select(*keys, "b", "q.at", "q.sign").filter("at > 0")
    found = scan.matched(asked, prefix, [*keys, "at"], "inner")
    sums = found.groupBy(*keys, "b").agg(*(F.sum(F.col("sign") * F.col("prefix")[i]).alias(f"d{i}") for i in range(m)))
    # Products of rows k apart, for all k up to the lags of the group.
    window = Window.partitionBy(*keys, "chunk").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    span = sizes.agg(F.max("lags")).first()[0] or 1
    halo = placed.select(*keys, "position", "centred", "lags", F.explode(F.array(F.floor(F.col("position") / span), F.floor(F.col("position") / span) + 1)).alias("chunk"))
    near = halo.withColumn("own", F.floor(F.col("position") / span) == F.col("chunk")).withColumn("before", F.collect_list("centred").over(window)).filter("own")
    near = near.select(*keys, "centred", F.posexplode(F.slice(F.reverse("before"), F.lit(1), (F.col("lags") + 1).cast("int"))).alias("k", "other"))
    crossed = near.groupBy(*keys, "k").agg(*(F.avg(F.col("centred")[i] * F.col("other")[j]).alias(f"g{i}_{j}") for i in range(m) for j in range(m)))
    weight = F.when(F.col("k") == 0, 1.0).otherwise(2.0 * (1 - F.col("k") / (F.col("lags") + 1)))
    pairs = [(i, j) for i in range(m) for j in range(i + 1, m)]
    lrv = grouped(crossed, sizes.select(*keys, "n", "lags")).groupBy(*keys).agg(*(
        F.sqrt(F.greatest(F.sum(weight * (F.col(f"g{i}_{i}") + F.col(f"g{j}_{j}") - F.col(f"g{i}_{j}") - F.col(f"g{j}_{i}"))), F.lit(float(np.finfo(float).eps))) / F.first("n")).alias(f"se{i}_{j}") for i, j in pairs))
    state = materialize(grouped(sizes.select(*keys, "n", "mean"), lrv).withColumns({f"in{i}": F.lit(True) for i in range(m)} | {f"out{i}": F.lit(None).cast("double") for i in range(m)} | {"p": F.lit(1.0), "going": F.lit(True)}), "mcs-state")
    sums = materialize(sums, "mcs-draws")

    def largest(value) -> Column:
        return F.greatest(*(F.when(F.col(f"in{i}") & F.col(f"in{j}"), value(i, j) / F.col(f"se{i}_{j}")).otherwise(0.0) for i, j in pairs), F.lit(0.0))

    for _ in range(m - 1):
        state = state.withColumn("stat", largest(lambda i, j: F.abs(F.col("mean")[i] - F.col("mean")[j])))
        each = grouped(sums, state).withColumn("draw", largest(lambda i, j: F.abs(F.col(f"d{i}") - F.col(f"d{j}")) / F.col("n")))
        p = each.groupBy(*keys).agg(((1 + F.count_if(F.col("draw") >= F.col("stat"))) / (n_bootstrap + 1)).alias("p_now"))
        state = grouped(state, p)
        active = [F.when(F.col(f"in{i}"), F.col("mean")[i]) for i in range(m)]
        worst = F.array_position(F.array(*(F.coalesce(a, F.lit(float("-inf"))) for a in active)), F.greatest(*active, F.lit(float("-inf")))) - 1
        goes = F.col("going") & (F.col("p_now") <= alpha)
        left = F.lit(0)
        for i in range(m):
            left += F.col(f"in{i}").cast("int")
        state = state.withColumn("worst", worst).withColumn("goes", goes & (left > 1)).withColumn("p", F.when(F.col("going") & (left > 1), F.col("p_now")).otherwise(F.col("p")))
        state = state.withColumns({f"out{i}": F.when(F.col("goes") & (F.col("worst") == i), F.col("p_now")).otherwise(F.col(f"out{i}")) for i in range(m)} | {f"in{i}": F.col(f"in{i}") & ~(F.col("goes") & (F.col("worst") == i)) for i in range(m)})
        state = materialize(state.withColumn("going", F.col("goes")).drop("stat", "p_now", "worst", "goes"), "mcs-state")
    each = F.array(*(F.struct(F.lit(x).alias("model"), F.col(f"in{i}").alias("included"), F.coalesce(f"out{i}", "p").alias("p_value")) for i, x in enumerate(models)))
    return state.select(*keys, F.explode(each).alias("e")).select(*keys, "e.*")
