"""Models as grouped operators: one fit for each group, groups in parallel, results as rows.

The walk-forward module uses the same kernels by fold; here the groups are any
columns. Fits that fail or don't converge are rows with a status, not errors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrace.operators import scan
from voltrace.operators.kernels import boost, gjr, hmm
from voltrace.operators.walkforward import resolve_feature_columns
from voltrace.runtime import spread

SIMPLEX_SLACK = 1e-6


class ModelError(ValueError):
    """Inputs that a model can't take."""


def _kinds(df: DataFrame, by) -> str:
    return "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)


def fit_gjr_garch(df: DataFrame, *, by=("asset_id",), order: str = "timestamp", column: str = "return") -> DataFrame:
    """(by..., omega, alpha, gamma, beta, mu, log_likelihood, converged, observations, forecast_variance, forecast_volatility)."""
    names = ["omega", "alpha", "gamma", "beta", "mu", "log_likelihood"]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[column].to_numpy(dtype=float)
        x = x[np.isfinite(x)]
        try:
            f = gjr.fit(x)
            row = [*(getattr(f, n) for n in names), f.converged, len(x), f.forecast_variance, f.forecast_variance**0.5]
        except ValueError:
            row = [np.nan] * 6 + [False, len(x), np.nan, np.nan]
        return pd.DataFrame([[*key, *row]])

    fields = ", ".join(f"{n} double" for n in names) + ", converged boolean, observations int, forecast_variance double, forecast_volatility double"
    return spread(df.select(*by, order, column), *by).groupBy(*by).applyInPandas(one, _kinds(df, by) + fields)


def conditional_volatility(df: DataFrame, *, by=("asset_id",), order: str = "timestamp", column: str = "return") -> DataFrame:
    """(by..., order, conditional_variance, conditional_volatility): the in-sample series of each group's fit."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[np.isfinite(pdf[column].astype(float))].sort_values(order)
        try:
            v = gjr.fit(pdf[column].to_numpy(dtype=float)).variance
        except ValueError:
            v = np.full(len(pdf), np.nan)
        return pd.DataFrame({**{c: pdf[c] for c in (*by, order)}, "conditional_variance": v, "conditional_volatility": np.sqrt(v)})

    return spread(df.select(*by, order, column), *by).groupBy(*by).applyInPandas(one, _kinds(df, by) + f"{order} {df.schema[order].dataType.simpleString()}, conditional_variance double, conditional_volatility double")


def garch_variance(df: DataFrame, parameters: DataFrame, *, by=("asset_id",), order: str = "timestamp", column: str = "return") -> DataFrame:
    """(by..., order, conditional_variance, conditional_volatility) for given parameters (by..., mu, omega, alpha, gamma, beta), beta below 1.

    The first variance is that of the group's returns; each next one is omega + (alpha, and gamma after a fall) * e^2 + beta * v. That is a decayed sum, so a
    group is dealt over many tasks and no Python runs. Null and non-finite returns are left out, groups without parameters too.
    """
    x = F.col(column).cast("double")
    rows = df.select(*by, order, x.alias("__r")).filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    first = rows.groupBy(*by).agg(F.var_pop("__r").alias("__first"))  # a row for each group
    given = scan.matched(first, parameters.select(*by, "mu", "omega", "alpha", "gamma", "beta"), by, "inner") if by else first.crossJoin(F.broadcast(parameters))
    placed = scan.positions(rows, by, [order, "__r"], "__position", "garch")
    placed = scan.matched(placed, given, by, "inner") if by else placed.crossJoin(F.broadcast(given))
    e = F.col("__r") - F.col("mu")
    step = F.col("omega") + (F.col("alpha") + F.when(e < 0, F.col("gamma")).otherwise(0.0)) * e * e
    made = scan.decayed_sum(placed, step, "beta", by, name="__sum", position="__position", exclusive=True)
    v = F.pow("beta", "__position") * F.col("__first") + F.col("__sum")
    return made.select(*by, order, v.alias("conditional_variance"), F.sqrt(v).alias("conditional_volatility"))


def filter_regimes(df: DataFrame, observations: list[str], m: hmm.Model, *, by=("asset_id",), order: str = "timestamp", state: np.ndarray | None = None) -> DataFrame:
    """(by..., order, regime_probability_0..): filtered probabilities of every row for a given model, with groups of any size dealt over many tasks.

    A part of a group acts on the state before it as a matrix: the scaled product of its rows' transitions and densities. Those matrices, one for each part, are
    multiplied along a group, and each part is filtered from the state that enters it. state: a state before each group's first row, instead of the start.
    Rows with null or non-finite observations are left out.
    """
    names = [f"regime_probability_{k}" for k in range(m.config.n_components)]
    whole = F.lit(True)
    for c in observations:
        whole &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    parts = scan.in_parts(df.filter(F.coalesce(whole, F.lit(False))).select(*by, order, *(F.col(c).cast("double").alias(c) for c in observations)), by, [order, *observations], "regimes")
    keys = [*by, scan.PART]

    def product(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, m.product(pdf.sort_values([order, *observations])[observations].to_numpy()).ravel().tolist()]])

    def along(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out, at = pdf.sort_values(scan.PART), [], state
        for part, flat in zip(pdf[scan.PART], pdf["m"], strict=True):
            out.append([*key, part, None if at is None else list(map(float, at))])
            at = (m.start if at is None else at @ m.transition) @ np.asarray(flat).reshape(m.transition.shape)
            at = at / at.sum()
        return pd.DataFrame(out)

    def filtered(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, *observations])
        at = pdf["__state"].iloc[0]
        p = m.filter(pdf[observations].to_numpy(), None if at is None else np.asarray(at))
        return pd.DataFrame({**{c: pdf[c] for c in (*by, order)}, **dict(zip(names, p.T, strict=True))})

    kinds = _kinds(df, by)
    products = parts.groupBy(*keys).applyInPandas(product, f"{kinds}{scan.PART} int, m array<double>")
    states = products.groupBy(*by).applyInPandas(along, f"{kinds}{scan.PART} int, __state array<double>")  # a row for each part of a group
    rows = scan.matched(parts, states, keys)
    return rows.groupBy(*keys).applyInPandas(filtered, f"{kinds}{order} {df.schema[order].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names))


def fit_hmm(df: DataFrame, observations: list[str], *, config: hmm.Config = hmm.Config(), by=("asset_id",), order: str = "timestamp") -> DataFrame:
    """(by..., order, regime_probability_0.., log_likelihood, iterations, converged): filtered probabilities of every row."""
    names = [f"regime_probability_{k}" for k in range(config.n_components)]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[observations].to_numpy(dtype=float)
        pdf = pdf[np.isfinite(x).all(axis=1)].sort_values(order)
        out = pdf[[*by, order]].copy()
        try:
            m = hmm.fit(pdf[observations].to_numpy(dtype=float), config)
            p, rest = m.filter(pdf[observations].to_numpy(dtype=float)), (m.log_likelihood, m.iterations, m.converged)
        except (ValueError, np.linalg.LinAlgError):
            p, rest = np.full((len(pdf), len(names)), np.nan), (np.nan, 0, False)
        for k, name in enumerate(names):
            out[name] = p[:, k]
        out["log_likelihood"], out["iterations"], out["converged"] = rest
        return out

    fields = f"{order} {df.schema[order].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names) + ", log_likelihood double, iterations int, converged boolean"
    return spread(df.select(*by, order, *observations), *by).groupBy(*by).applyInPandas(one, _kinds(df, by) + fields)


def regime_columns(df: DataFrame) -> list[str]:
    found = sorted((c for c in df.columns if c.startswith("regime_probability_")), key=lambda c: int(c.rsplit("_", 1)[1]))
    if not found:
        raise ModelError("no regime probabilities")
    return found


def predict_regimes(df: DataFrame) -> DataFrame:
    """Adds regime: the first state of the largest probability."""
    p = F.array(*regime_columns(df))
    return df.withColumn("regime", (F.array_position(p, F.array_max(p)) - 1).cast("int"))


def on_simplex(columns: list[str]) -> Column:
    total, ok = F.lit(0.0), F.lit(True)
    for c in columns:
        total, ok = total + F.col(c), ok & F.col(c).between(-SIMPLEX_SLACK, 1 + SIMPLEX_SLACK)
    return F.coalesce(ok & (F.abs(total - 1) <= SIMPLEX_SLACK), F.lit(False))


def simplex_violations(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(~on_simplex(regime_columns(df))).alias("n"))


class PooledTrees:
    """Boosted trees over a whole table, distributed: the library's gradient-boosted regressor on an assembled vector."""

    def __init__(self, *, n_estimators: int = 20, max_depth: int = 5, learning_rate: float = 0.1, seed: int = 42) -> None:
        self.settings, self.model, self.features = {"maxIter": n_estimators, "maxDepth": max_depth, "stepSize": learning_rate, "seed": seed}, None, []

    def _assembled(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.features, outputCol="__features", handleInvalid="skip").transform(df)

    def fit(self, df: DataFrame, target: str = "target", feature_columns=None) -> PooledTrees:
        from pyspark.ml.regression import GBTRegressor

        self.features = resolve_feature_columns(df, feature_columns)
        self.model = GBTRegressor(featuresCol="__features", labelCol=target, **self.settings).fit(self._assembled(df))
        return self

    def predict(self, df: DataFrame, name: str = "xgboost_forecast") -> DataFrame:
        """(timestamp, asset_id, name); forecasts below 0 become 0."""
        if self.model is None:
            raise ModelError("fit first")
        out = self.model.transform(self._assembled(df))
        return out.select("timestamp", "asset_id", F.greatest(F.col("prediction"), F.lit(0.0)).alias(name))

    def fit_predict(self, df: DataFrame, target: str = "target", feature_columns=None) -> DataFrame:
        return self.fit(df, target, feature_columns).predict(df)

    def feature_importance(self, spark) -> DataFrame:
        """(feature, importance), the largest first."""
        rows = [(f, float(v)) for f, v in zip(self.features, self.model.featureImportances.toArray(), strict=True)]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


class PooledRegimeTrees(PooledTrees):
    """The same with regime probabilities as features; rows whose probabilities aren't on the simplex are refused."""

    def fit(self, df: DataFrame, target: str = "target", feature_columns=None) -> PooledRegimeTrees:
        bad = simplex_violations(df).first().n
        if bad:
            raise ModelError(f"{bad} rows aren't on the simplex")
        base = [c for c in resolve_feature_columns(df, feature_columns) if c not in regime_columns(df)]
        return super().fit(df, target, [*base, *regime_columns(df)])

    def predict(self, df: DataFrame, name: str = "regime_xgboost_forecast") -> DataFrame:
        return super().predict(df, name)


def fit_trees(df: DataFrame, features: list[str], *, target: str = "target", by=("asset_id",), config: boost.Config = boost.Config(), order: str = "timestamp") -> DataFrame:
    """(by..., order, forecast): in-sample forecasts of one boosted model for each group."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[*features, target]).sort_values(order)
        out = pdf[[*by, order]].copy()
        out["forecast"] = np.maximum(boost.fit(pdf[features].to_numpy(dtype=float), pdf[target].to_numpy(dtype=float), config).predict(pdf[features].to_numpy(dtype=float)), 0.0) if len(pdf) else []
        return out

    return spread(df.select(*by, order, target, *features), *by).groupBy(*by).applyInPandas(one, _kinds(df, by) + f"{order} {df.schema[order].dataType.simpleString()}, forecast double")


def simulate_by_group(z: DataFrame, forecasts: DataFrame, *, by=("asset_id",), n_simulations: int = 10_000, seed: int = 42) -> DataFrame:
    """(by..., draw, simulated_return): each group's own residuals z, drawn with replacement, times its forecast_volatility."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["timestamp", "z"])
        draws = np.random.default_rng(seed).choice(pdf["z"].to_numpy(), size=n_simulations) * pdf["forecast_volatility"].iloc[0]
        return pd.DataFrame({**{c: [k] * n_simulations for c, k in zip(by, key, strict=True)}, "draw": np.arange(n_simulations), "simulated_return": draws})

    rows = z.select(*by, "timestamp", "z").join(forecasts.select(*by, "forecast_volatility"), list(by))
    return rows.groupBy(*by).applyInPandas(one, _kinds(z, by) + "draw long, simulated_return double")
