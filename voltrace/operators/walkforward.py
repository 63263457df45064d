"""Walk-forward folds and models. Folds are independent, so they are groups of one plan rather than a loop.

Timestamps are ranked once; a row's folds follow from its rank by arithmetic
and are exploded, so no range join is needed. Each rolling window repeats a
row about train / step times: columns are projected first.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltrace.operators import ewma, scan
from voltrace.operators.kernels import boost, gjr, hmm
from voltrace.runtime import materialize, numbered, spread

MODELS = ("EWMA", "GJR-GARCH", "XGBoost", "Regime-XGBoost")
ABLATIONS = {"A0": (False, False), "A1": (True, False), "A2": (False, True), "A3": (True, True)}
#: Folds in a row whose GARCH fits are one group.
NEIGHBOURS = 32
#: Windows over which a weight falls by e to this power at most are forecast from running sums; longer ones, and expanding ones, fold by fold.
LONGEST = 600.0
NOT_FEATURES = ("timestamp", "asset_id", "trading_date", "target", "realized_volatility", "realized_variance", "fold_id", "role", "rank")


class WalkForwardError(ValueError):
    """Impossible folds or predictions."""


def _sizes(train: int, test: int, step: int | None) -> tuple[int, int, int]:
    step = test if step is None else step
    if min(train, test, step) < 1:
        raise WalkForwardError("train, test and step must be positive")
    return train, test, step


def ranked_timestamps(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """(timestamp, rank from 0): the calendar, numbered by parts."""
    return scan.positions(df.select(column).distinct(), (), (column,), "rank", "calendar")


def fold_table(df: DataFrame, *, train_size: int, test_size: int = 1, step_size: int | None = None, expanding: bool = False, timestamp_column: str = "timestamp", by_row: bool = False) -> DataFrame:
    """(fold_id, train_start, train_end, test_start, test_end) over distinct timestamps, or row positions with by_row."""
    train, test, step = _sizes(train_size, test_size, step_size)
    if by_row:
        calendar = numbered(df.select(timestamp_column), timestamp_column, name="rank", tag="fold-rows")
    else:
        calendar = ranked_timestamps(df, timestamp_column)
    n = calendar.agg(F.count(F.lit(1)).alias("n"))
    folds = n.withColumn("folds", F.floor((F.col("n") - train - test) / step) + 1).filter("folds > 0").select(F.explode(F.sequence(F.lit(0), F.col("folds") - 1)).alias("fold_id"))
    first = F.lit(0) if expanding else F.col("fold_id") * step
    bounds = folds.select("fold_id", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), at.cast("long").alias("rank")) for name, at in (
        ("train_start", first), ("train_end", F.col("fold_id") * step + train - 1), ("test_start", F.col("fold_id") * step + train), ("test_end", F.col("fold_id") * step + train + test - 1))))).alias("b")).select("fold_id", "b.*")
    named = bounds.join(calendar, "rank").groupBy("fold_id").pivot("name", ["train_start", "train_end", "test_start", "test_end"]).agg(F.first(timestamp_column))
    return named.withColumn("fold_id", F.col("fold_id").cast("int"))


def split_indices(df: DataFrame, **options) -> DataFrame:
    return fold_table(df, by_row=True, **options)


def assign_folds(df: DataFrame, *, train_size: int, test_size: int = 1, step_size: int | None = None, expanding: bool = False, purge: int = 0) -> DataFrame:
    """df with fold_id and role (train, test), a row for each fold that it is in. purge: timestamps left out before each test."""
    train, test, step = _sizes(train_size, test_size, step_size)
    calendar = ranked_timestamps(df)
    n = calendar.agg(F.count(F.lit(1)).alias("n"))
    rank = F.col("rank")
    last = F.floor((F.col("n") - train - test) / step)
    up = F.floor(rank / step) if not expanding else last
    low = F.greatest(F.lit(0), F.ceil((rank - train - test + 1) / step))
    folds = calendar.crossJoin(F.broadcast(n)).filter(last >= 0)  # n: one row
    folds = folds.withColumn("low", low.cast("int")).withColumn("up", F.least(up, last).cast("int")).filter("low <= up")
    folds = folds.select("timestamp", "rank", F.explode(F.sequence("low", "up")).alias("fold_id"))
    at = F.col("rank") - F.col("fold_id") * step - train
    folds = folds.withColumn("role", F.when((at >= 0) & (at < test), "test").when((at < -purge) & (F.lit(expanding) | (at >= -train)), "train")).filter("role is not null")
    return df.join(folds.select("timestamp", "fold_id", "role"), "timestamp")


def create_fold_from_positions(df: DataFrame, *, fold_id: int, train_start: int, train_end: int, test_start: int, test_end: int, timestamp_column: str = "timestamp") -> DataFrame:
    """Rows of one fold by positions [start, end) in time order, with fold_id and role."""
    if not (0 <= train_start < train_end <= test_start < test_end):
        raise WalkForwardError("positions must be ordered and disjoint")
    others = [c for c in df.columns if c != timestamp_column]
    placed = numbered(df, timestamp_column, *others, name="__at", tag="fold-rows")
    role = F.when(F.col("__at").between(train_start, train_end - 1), "train").when(F.col("__at").between(test_start, test_end - 1), "test")
    return placed.withColumn("fold_id", F.lit(fold_id)).withColumn("role", role).filter("role is not null").drop("__at")


def create_fold(df: DataFrame, *, fold_id: int, train_indices, test_indices, timestamp_column: str = "timestamp") -> DataFrame:
    """As create_fold_from_positions, from lists of positions; train must end before test starts."""
    train, test = sorted(set(train_indices)), sorted(set(test_indices))
    if not train or not test or set(train) & set(test) or train[-1] >= test[0]:
        raise WalkForwardError("train must come before test and share no row with it")
    others = [c for c in df.columns if c != timestamp_column]
    placed = numbered(df, timestamp_column, *others, name="__at", tag="fold-rows")
    role = F.when(F.col("__at").isin(train), "train").when(F.col("__at").isin(test), "test")
    return placed.withColumn("fold_id", F.lit(fold_id)).withColumn("role", role).filter("role is not null").drop("__at")


PREDICTIONS = T.StructType([
    T.StructField("timestamp", T.TimestampType()), T.StructField("asset_id", T.StringType()), T.StructField("prediction", T.DoubleType()),
    T.StructField("actual_volatility", T.DoubleType()), T.StructField("fold_id", T.IntegerType())])


def run(df: DataFrame, predict: Callable[[pd.DataFrame, pd.DataFrame, int], pd.DataFrame], schema: T.StructType | str = PREDICTIONS, **folds) -> DataFrame:
    """predict(train, test, fold_id) for every fold, each fold a task's group (a training window of all assets must fit one)."""
    names = [f.name for f in (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["timestamp", "asset_id"])
        fold = int(pdf["fold_id"].iloc[0])
        train, test = (pdf[pdf["role"] == r].drop(columns=["role", "fold_id"]).reset_index(drop=True) for r in ("train", "test"))
        out = predict(train, test, fold)
        out["fold_id"] = np.int32(fold)
        return out[names]

    return spread(assign_folds(df, **folds), "fold_id").groupBy("fold_id").applyInPandas(one, schema)


def resolve_feature_columns(df: DataFrame, feature_columns=None) -> list[str]:
    """Those given, else all numeric columns but keys, target and realised measures."""
    if feature_columns:
        missing = [c for c in feature_columns if c not in df.columns]
        if missing:
            raise WalkForwardError(f"missing features {missing}")
        return list(feature_columns)
    found = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in NOT_FEATURES]
    if not found:
        raise WalkForwardError("no numeric features")
    return found


def predict_ewma(rows: DataFrame, target: str, decay: float = 0.94) -> DataFrame:
    """From rows with fold_id and role: one forecast for each fold and asset, native."""
    v = rows.filter("role = 'train'").groupBy("fold_id", "asset_id").agg(ewma.ordered_returns().alias("r")).select("fold_id", "asset_id", F.sqrt(ewma.forecast_variance(F.col("r"), decay)).alias("prediction"))
    test = rows.filter("role = 'test'").select("timestamp", "asset_id", F.col(target).alias("actual_volatility"), "fold_id")
    return test.join(v, ["fold_id", "asset_id"]).select("timestamp", "asset_id", "prediction", "actual_volatility", F.col("fold_id").cast("int").alias("fold_id"))


def rolling_ewma(df: DataFrame, target: str, decay: float = 0.94, *, train_size: int, test_size: int = 1, step_size: int | None = None, purge: int = 0) -> DataFrame:
    """predict_ewma over rolling folds, with each row moved once however many windows hold it.

    Windows have the same length in timestamps, so one covers the end of a block of that length and the start of the next. In a block, running sums from both
    ends give what a window needs at its two ends; probes, two for each asset and fold that has a test row, are ordered among the rows and read them off. No
    difference of sums is taken. Rows without a return are left out; an asset without a row in a window has no forecast there.
    """
    train, test, step = _sizes(train_size, test_size, step_size)
    length, d = train - purge, float(decay)
    if length < 1 or not 0 < d < 1:
        raise WalkForwardError("the window must hold a timestamp and the decay lie between 0 and 1")
    calendar = ranked_timestamps(df)
    last = calendar.agg(F.floor((F.count(F.lit(1)) - train - test) / step).alias("__last"))  # one row
    at = F.col("rank") - train
    placed = df.select("timestamp", "asset_id", F.col("return").cast("double").alias("__r"), F.col(target).alias("actual_volatility")).join(calendar, "timestamp")
    low, up = F.greatest(F.lit(0), F.ceil((at - test + 1) / step)), F.least(F.floor(at / step), F.col("__last"))
    tests = placed.crossJoin(F.broadcast(last)).withColumn("__low", low.cast("int")).withColumn("__up", up.cast("int")).filter((at >= 0) & (F.col("__low") <= F.col("__up")))
    tests = tests.select("timestamp", "asset_id", "actual_volatility", F.explode(F.sequence("__low", "__up")).alias("fold_id"))
    first = F.col("fold_id").cast("long") * step
    start, end = (F.struct(F.floor(x / length).alias("block"), x.alias("rank"), F.lit(kind).alias("kind")) for x, kind in ((first, 0), (first + length - 1, 2)))
    # A window that is a whole block needs its end alone.
    probes = tests.select("asset_id", "fold_id").distinct().select("asset_id", "fold_id", F.explode(F.when(first % length == 0, F.array(end)).otherwise(F.array(start, end))).alias("p"))
    probes = probes.select("asset_id", "p.block", "p.rank", "p.kind", "fold_id", F.lit(None).cast("double").alias("x"))
    rows = placed.filter(F.col("__r").isNotNull() & ~F.isnan("__r")).select("asset_id", F.floor(F.col("rank") / length).alias("block"), "rank", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("fold_id"), (F.col("__r") * F.col("__r")).alias("x"))
    block = Window.partitionBy("asset_id", "block")
    up_to, from_here = (block.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) for order in (("rank", "kind", "x"), (F.desc("rank"), F.desc("kind"), F.desc("x"))))
    both = rows.unionByName(probes).withColumn("__n", F.count("x").over(up_to))
    both = both.withColumn("__sum", F.sum(F.col("x") * F.pow(F.lit(d), -F.col("__n"))).over(up_to)).withColumn("__head", F.first("x", ignorenulls=True).over(up_to))
    both = both.withColumn("__m", F.count("x").over(from_here)).withColumn("__tail", F.sum(F.col("x") * F.pow(F.lit(d), F.col("__m") - 1)).over(from_here)).withColumn("__oldest", F.last("x", ignorenulls=True).over(from_here))
    ends, is_end = both.filter("fold_id is not null"), F.col("kind") == 2
    seen = ends.groupBy("asset_id", "fold_id").agg(
        F.max(F.when(is_end, F.col("__n"))).alias("n_new"), F.max(F.when(is_end, F.col("__sum") * F.pow(F.lit(d), F.col("__n")))).alias("new"), F.max(F.when(is_end, F.col("__head"))).alias("first_new"),
        F.max(F.when(~is_end, F.col("__m"))).alias("n_old"), F.max(F.when(~is_end, F.col("__tail"))).alias("old"), F.max(F.when(~is_end, F.col("__oldest"))).alias("first_old"))
    n_old, zero = F.coalesce("n_old", F.lit(0)), F.lit(0.0)
    total = F.coalesce("new", zero) + F.pow(F.lit(d), F.col("n_new")) * F.coalesce("old", zero)
    v = F.pow(F.lit(d), F.col("n_new") + n_old) * F.coalesce("first_old", "first_new") + (1 - d) * total
    found = seen.filter(F.col("n_new") + n_old > 0).select("asset_id", "fold_id", F.sqrt(v).alias("prediction"))
    return tests.join(found, ["asset_id", "fold_id"]).select("timestamp", "asset_id", "prediction", "actual_volatility", F.col("fold_id").cast("int").alias("fold_id"))


def garch_features(df: DataFrame, *, train_size: int, test_size: int = 1, step_size: int | None = None, expanding: bool = False, purge: int = 0, forecasts_only: bool = False) -> DataFrame:
    """(fold_id, role, timestamp, asset_id, garch_forecast, garch_converged): in-sample volatility for train rows, the one-step forecast for test rows.

    A group is NEIGHBOURS folds in a row of one asset, whose windows share most rows: a row is moved once for each group, not for each fold, and each fit also
    starts from those beside it. Groups follow from fold numbers, so reruns agree. forecasts_only leaves train rows out.
    """
    train, test, step = _sizes(train_size, test_size, step_size)
    calendar = ranked_timestamps(df)
    n = calendar.agg(F.count(F.lit(1)).alias("__n"))  # one row
    last = F.floor((F.col("__n") - train - test) / step)
    low = F.greatest(F.lit(0), F.ceil((F.col("rank") - train - test + 1) / step))
    up = last if expanding else F.least(F.floor(F.col("rank") / step), last)
    groups = calendar.crossJoin(F.broadcast(n)).filter((last >= 0) & (low <= up)).select("timestamp", "rank", last.cast("int").alias("__last"), F.explode(F.sequence(F.floor(low / NEIGHBOURS).cast("int"), F.floor(up / NEIGHBOURS).cast("int"))).alias("__group"))
    rows = df.select("timestamp", "asset_id", "return").join(groups, "timestamp")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp")
        rank, returns, out, folds = pdf["rank"].to_numpy(), pdf["return"].to_numpy(dtype=float), [], []
        first = int(pdf["__group"].iloc[0]) * NEIGHBOURS
        for fold in range(first, min(first + NEIGHBOURS, int(pdf["__last"].iloc[0]) + 1)):
            at = rank - fold * step
            is_train, is_test = (at < train - purge) & (expanding | (at >= 0)), (at >= train) & (at < train + test)
            kept = is_test if forecasts_only else is_train | is_test
            if kept.any():
                folds.append((fold, is_train, is_test, kept))
        for (fold, is_train, is_test, kept), got in zip(folds, gjr.fits([returns[f[1]] for f in folds]), strict=True):
            value, converged = np.full(len(pdf), np.nan), got is not None and got.converged
            if got is not None:
                value[is_train], value[is_test] = np.sqrt(got.variance), math.sqrt(got.forecast_variance)
            out.append(pd.DataFrame({"fold_id": np.int32(fold), "role": np.where(is_test[kept], "test", "train"), "timestamp": pdf["timestamp"][kept], "asset_id": pdf["asset_id"][kept],
                                     "garch_forecast": value[kept], "garch_converged": converged}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("fold_id", "role", "timestamp", "asset_id", "garch_forecast", "garch_converged")})

    return spread(rows, "asset_id", "__group").groupBy("asset_id", "__group").applyInPandas(
        one, "fold_id int, role string, timestamp timestamp, asset_id string, garch_forecast double, garch_converged boolean")


def hmm_features(rows: DataFrame, config: hmm.Config = hmm.Config()) -> DataFrame:
    """(fold_id, role, timestamp, asset_id, regime_probability_0.., hmm_converged, hmm_iterations): filtered on train, continued on test."""
    names = [f"regime_probability_{k}" for k in range(config.n_components)]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp")
        train = (pdf["role"] == "train").to_numpy()
        x = np.column_stack([pdf["return"], pdf["realized_volatility"], (pdf["high"] - pdf["low"]) / pdf["close"].abs()])
        out = pdf[["fold_id", "role", "timestamp", "asset_id"]].copy()
        p = np.full((len(pdf), config.n_components), 1 / config.n_components)
        try:
            m = hmm.fit(x[train], config)
            p[train] = m.filter(x[train])
            if (~train).any():
                p[~train] = m.filter_after_training(x[~train])
            out["hmm_converged"], out["hmm_iterations"] = m.converged, m.iterations
        except (ValueError, np.linalg.LinAlgError):
            out["hmm_converged"], out["hmm_iterations"] = False, 0
        for k, name in enumerate(names):
            out[name] = p[:, k]
        return out[["fold_id", "role", "timestamp", "asset_id", *names, "hmm_converged", "hmm_iterations"]]

    cols = ["fold_id", "role", "timestamp", "asset_id", "return", "realized_volatility", "high", "low", "close"]
    return spread(rows.select(*cols), "fold_id", "asset_id").groupBy("fold_id", "asset_id").applyInPandas(
        one, "fold_id int, role string, timestamp timestamp, asset_id string, " + ", ".join(f"{n} double" for n in names) + ", hmm_converged boolean, hmm_iterations int")


def predict_trees(rows: DataFrame, target: str, features: list[str], config: boost.Config = boost.Config(), keep: list[str] = ()) -> DataFrame:
    """Boosted trees pooled across the assets of a fold; forecasts below 0 become 0."""
    keep = list(keep)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["timestamp", "asset_id"])
        ok = np.isfinite(pdf[features].to_numpy(dtype=float)).all(axis=1)
        train, test = pdf[(pdf["role"] == "train") & ok & np.isfinite(pdf[target])], pdf[(pdf["role"] == "test") & ok]
        out = test[["timestamp", "asset_id", *keep]].copy()
        if len(train):
            m = boost.fit(train[features].to_numpy(), train[target].to_numpy(), config)
            out["prediction"] = np.maximum(m.predict(test[features].to_numpy()), 0.0) if len(test) else []
        else:
            out["prediction"] = np.nan
        out["actual_volatility"], out["fold_id"] = test[target], test["fold_id"].astype("int32")
        return out[["timestamp", "asset_id", "prediction", "actual_volatility", "fold_id", *keep]]

    cols = list(dict.fromkeys(["fold_id", "role", "timestamp", "asset_id", target, *features, *keep]))
    return spread(rows.select(*cols), "fold_id").groupBy("fold_id").applyInPandas(
        one, "timestamp timestamp, asset_id string, prediction double, actual_volatility double, fold_id int" + "".join(f", {k} double" for k in keep))


def _with(rows: DataFrame, *, garch: DataFrame | None = None, regimes: DataFrame | None = None) -> DataFrame:
    keys = ["fold_id", "role", "timestamp", "asset_id"]
    for extra in (garch, regimes):
        if extra is not None:
            rows = rows.join(extra, keys)
    return rows


def run_model(df: DataFrame, model: str, *, target: str = "target", decay: float = 0.94, hmm_config: hmm.Config = hmm.Config(), boost_config: boost.Config = boost.Config(), feature_columns=None, **folds) -> DataFrame:
    """Predictions of one model over all folds, with the column ``model``."""
    if model not in MODELS:
        raise WalkForwardError(f"unknown model {model}")
    if model in ("GJR-GARCH", "Regime-XGBoost") and folds.get("test_size", 1) != 1:
        raise WalkForwardError("a one-step forecast needs test_size 1")
    if model == "EWMA" and not folds.get("expanding") and folds["train_size"] * -math.log(decay) < LONGEST:
        return rolling_ewma(df, target, decay, **{k: v for k, v in folds.items() if k != "expanding"}).withColumn("model", F.lit(model))
    rows = assign_folds(df, **folds).withColumn("fold_id", F.col("fold_id").cast("int"))
    if model == "EWMA":
        out = predict_ewma(rows, target, decay)
    elif model == "GJR-GARCH":
        g = garch_features(df, forecasts_only=True, **folds)
        out = rows.filter("role = 'test'").join(g.select("fold_id", "timestamp", "asset_id", "garch_forecast"), ["fold_id", "timestamp", "asset_id"]).select(
            "timestamp", "asset_id", F.col("garch_forecast").alias("prediction"), F.col(target).alias("actual_volatility"), "fold_id")
    elif model == "XGBoost":
        out = predict_trees(rows, target, resolve_feature_columns(df, feature_columns), boost_config)
    else:
        return run_ablation(df, "A3", target=target, hmm_config=hmm_config, boost_config=boost_config, feature_columns=feature_columns, **folds).drop("ablation").withColumn("model", F.lit(model))
    return out.withColumn("model", F.lit(model))


def run_ablation(df: DataFrame, ablation: str, *, target: str = "target", hmm_config: hmm.Config = hmm.Config(), boost_config: boost.Config = boost.Config(), feature_columns=None, **folds) -> DataFrame:
    """A0: trees; A1: with GARCH; A2: with regimes; A3: with both."""
    if ablation not in ABLATIONS:
        raise WalkForwardError(f"unknown ablation {ablation}")
    with_garch, with_regimes = ABLATIONS[ablation]
    if with_garch and folds.get("test_size", 1) != 1:
        raise WalkForwardError("a one-step forecast needs test_size 1")
    features = resolve_feature_columns(df, feature_columns)
    rows = assign_folds(df, **folds).withColumn("fold_id", F.col("fold_id").cast("int"))
    regime = [f"regime_probability_{k}" for k in range(hmm_config.n_components)]
    wide = _with(rows, garch=garch_features(df, **folds) if with_garch else None, regimes=hmm_features(rows, hmm_config) if with_regimes else None)
    extra = ["garch_forecast"] * with_garch + regime * with_regimes
    return predict_trees(wide, target, features + extra, boost_config, keep=extra).withColumn("ablation", F.lit(ablation))


def run_ablations(df: DataFrame, *, hmm_config: hmm.Config = hmm.Config(), boost_config: boost.Config = boost.Config(), target: str = "target", feature_columns=None, **folds) -> DataFrame:
    """All four, with GARCH and HMM fitted once for each fold and asset, and shared."""
    features = resolve_feature_columns(df, feature_columns)
    rows = assign_folds(df, **folds).withColumn("fold_id", F.col("fold_id").cast("int"))
    wide = materialize(_with(rows, garch=garch_features(df, **folds), regimes=hmm_features(rows, hmm_config)), "ablation-features")
    regime = [f"regime_probability_{k}" for k in range(hmm_config.n_components)]
    out = None
    for name, (g, h) in ABLATIONS.items():
        part = predict_trees(wide, target, features + ["garch_forecast"] * g + regime * h, boost_config).withColumn("ablation", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def validate_predictions(predictions: DataFrame, test_rows: DataFrame) -> DataFrame:
    """One row of counts, all 0 if valid: missing, unexpected, repeated, invalid."""
    keys = ["fold_id", "timestamp", "asset_id"]
    p = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction").isNull() | F.isnan("prediction") | (F.abs("prediction") == float("inf")) | (F.col("prediction") < 0)).alias("bad"))
    t = test_rows.select(*keys).distinct().withColumn("wanted", F.lit(1))
    return p.join(t, keys, "full").agg(
        F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("wanted").isNull()).alias("unexpected"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid"))


def feature_importance(df: DataFrame, target: str, features: list[str], config: boost.Config = boost.Config()) -> list[tuple[str, float]]:
    """Gain importances of one fit over a bounded training table."""
    pdf = df.select(target, *features).toPandas()
    m = boost.fit(pdf[features].to_numpy(), pdf[target].to_numpy(), config)
    return sorted(zip(features, map(float, m.importance()), strict=True), key=lambda x: (-x[1], x[0]))


def config_dict(config) -> dict:
    return asdict(config)
