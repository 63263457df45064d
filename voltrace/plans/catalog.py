"""The registered queries and their DuckDB SQL.

Hourly bars of ``events`` and daily bars of ``lineitem`` stand for market data.
Floating results are rounded to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltrace.operators import evaluation, ewma, features, portfolio, resampling, risk, stress, volatility, walkforward
from voltrace.operators.bars import daily_bars, hourly_bars
from voltrace.sources import contract
from voltrace.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOURLY = """WITH bars AS (
  SELECT date_trunc('hour', ts)::TIMESTAMP AS timestamp, upper(trim(event_type)) AS asset_id, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ts) AS close, count(*)::DOUBLE AS volume
  FROM events WHERE value > 0 GROUP BY 1, 2),
lr AS (SELECT *, CASE WHEN close > 0 THEN ln(close / lag(close) OVER (PARTITION BY asset_id ORDER BY timestamp)) END AS r FROM bars),
intraday AS (SELECT timestamp, asset_id, timestamp::DATE AS trading_date, ln(close / lag(close) OVER (PARTITION BY asset_id, timestamp::DATE ORDER BY timestamp)) AS log_return FROM bars),
rv AS (SELECT asset_id, trading_date, sum(log_return * log_return) AS realized_variance, sqrt(sum(log_return * log_return)) AS realized_volatility, count(*) AS observation_count
       FROM intraday WHERE log_return IS NOT NULL GROUP BY 1, 2)"""
#: Daily panel: simple returns of daily bars, 5-day volatility, and a naive forecast (volatility of the day before).
DAILY = """WITH ticks AS (SELECT *, l_extendedprice / l_quantity AS price FROM lineitem WHERE l_extendedprice / l_quantity > 0),
days AS (
  SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS timestamp, upper(trim(l_returnflag)) AS asset_id,
         arg_min(price, (l_shipdate, l_orderkey, l_linenumber)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (l_shipdate, l_orderkey, l_linenumber)) AS close, sum(l_quantity) AS volume
  FROM ticks GROUP BY 1, 2),
rets AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM days WINDOW w AS (PARTITION BY asset_id ORDER BY timestamp)),
vols AS (SELECT *, CASE WHEN count(ret) OVER w5 = 5 THEN stddev_samp(ret) OVER w5 END AS vol FROM rets WINDOW w5 AS (PARTITION BY asset_id ORDER BY timestamp ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
panel AS (SELECT timestamp, asset_id, ret, vol, lag(vol) OVER w AS naive, lag(vol, 5) OVER w AS older, lead(vol) OVER w AS target FROM vols WINDOW w AS (PARTITION BY asset_id ORDER BY timestamp))"""


def registered(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(f.name), digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields))


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return hourly_bars(table(spark, sf, "events"))


def panel(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """(timestamp, asset_id, return, volatility, naive, older, target) of daily bars, and extra columns of theirs."""
    w = Window.partitionBy("asset_id").orderBy("timestamp")
    r = F.col("close") / F.lag("close").over(w) - 1
    five = w.rowsBetween(-4, 0)
    v = daily_bars(table(spark, sf, "lineitem")).withColumn("return", r).withColumn("volatility", F.when(F.count("return").over(five) == 5, F.stddev_samp("return").over(five)))
    return v.select("timestamp", "asset_id", "return", "volatility", F.lag("volatility").over(w).alias("naive"), F.lag("volatility", 5).over(w).alias("older"), F.lead("volatility").over(w).alias("target"), *extra)


def usable_panel(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    return panel(spark, sf, *extra).filter("return is not null and volatility > 0 and naive > 0 and older > 0 and target > 0")


USABLE = f"{DAILY},\nok AS (SELECT timestamp, asset_id, ret AS \"return\", vol AS volatility, naive, older, target FROM panel WHERE ret IS NOT NULL AND vol > 0 AND naive > 0 AND older > 0 AND target > 0)"
# Contract -----------------------------------------------------------------------


@registered("hourly_bars", f"{HOURLY} SELECT timestamp, asset_id, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars")
def _(spark, sf):
    return rounded(contract.canonical_columns(bars(spark, sf)))


@registered("dataset_metadata", f"{HOURLY} SELECT string_agg(DISTINCT asset_id, ',' ORDER BY asset_id) AS asset_ids, count(*) AS row_count, min(timestamp) AS start, max(timestamp) AS \"end\" FROM bars")
def _(spark, sf):
    return contract.dataset_metadata(bars(spark, sf)).withColumn("asset_ids", F.array_join("asset_ids", ","))


@registered("validation_report", """WITH t AS (SELECT ts::TIMESTAMP AS timestamp, upper(trim(event_type)) AS asset_id, value AS open, value AS high, value AS low, value AS close, user_id::DOUBLE AS volume FROM events)
SELECT 'non_positive_close' AS rule, 'error' AS severity, count(*) FILTER (close <= 0) AS n FROM t
UNION ALL SELECT 'ohlc_relationship', 'error', count(*) FILTER (high < low) FROM t
UNION ALL SELECT 'negative_volume', 'error', count(*) FILTER (volume < 0) FROM t
UNION ALL SELECT 'zero_volume', 'warning', count(*) FILTER (volume = 0) FROM t
UNION ALL SELECT 'null_close', 'error', count(*) FILTER (close IS NULL) FROM t
UNION ALL SELECT 'duplicate_key', 'error', coalesce(sum(n) FILTER (n > 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM t GROUP BY timestamp, asset_id)""")
def _(spark, sf):
    v = F.col("value")
    raw = table(spark, sf, "events").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("asset_id"), v.alias("open"), v.alias("high"), v.alias("low"), v.alias("close"), F.col("user_id").alias("volume"))
    names = ("non_positive_close", "ohlc_relationship", "negative_volume", "zero_volume", "null_close", "duplicate_key")
    return contract.validate_ohlcv(contract.canonical_columns(raw)).filter(F.col("rule").isin(*names))


def _number_sql(c: str) -> str:
    """Text of a double without loss, as in the fingerprint's encoding: sign, integer below 2^53 and at least 2^52, power of two."""
    scaled = f"abs({c}) * pow(2.0, floor(-({{k}}) / 2)) * pow(2.0, -({{k}}) - floor(-({{k}}) / 2))"
    k = f"(floor(log2(abs({c}))) - 52)"
    at = scaled.format(k=k)
    power = f"({k} + CASE WHEN {at} >= 9007199254740992 THEN 1 WHEN {at} < 4503599627370496 THEN -1 ELSE 0 END)"
    return f"CASE WHEN {c} IS NULL THEN '' WHEN {c} = 0 THEN '0' ELSE CASE WHEN {c} < 0 THEN '-' ELSE '' END || ({scaled.format(k=power)})::BIGINT::VARCHAR || 'p' || {power}::BIGINT::VARCHAR END"


@registered("fingerprint", f"""{HOURLY},
h AS (SELECT md5(strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || ',' || asset_id || ',' || {" || ',' || ".join(_number_sql(c) for c in ("open", "high", "low", "close", "volume"))}) AS h FROM bars),
s AS (SELECT {", ".join(f"sum(('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT)::HUGEINT AS s{k}" for k in range(4))}, count(*) AS n FROM h),
a AS (SELECT n, s0, s1, s2, s3 % 4294967296 AS w3, s3 // 4294967296 AS c FROM s), b AS (SELECT n, s0, s1, w3, (s2 + c) % 4294967296 AS w2, (s2 + c) // 4294967296 AS c FROM a),
d AS (SELECT n, s0, w3, w2, (s1 + c) % 4294967296 AS w1, (s1 + c) // 4294967296 AS c FROM b), e AS (SELECT n, w3, w2, w1, (s0 + c) % 4294967296 AS w0 FROM d)
SELECT sha256(printf('%08x%08x%08x%08x', w0::BIGINT, w1::BIGINT, w2::BIGINT, w3::BIGINT) || ':' || n::VARCHAR) AS sha256, n AS row_count, (SELECT count(DISTINCT asset_id) FROM bars) AS asset_count,
       (SELECT strftime(min(timestamp), '%Y-%m-%dT%H:%M:%S') FROM bars) AS start, (SELECT strftime(max(timestamp), '%Y-%m-%dT%H:%M:%S') FROM bars) AS "end" FROM e""")
def _(spark, sf):
    return contract.fingerprint_row(bars(spark, sf))


# Volatility and features --------------------------------------------------------


@registered("intraday_log_returns", f"{HOURLY} SELECT timestamp, asset_id, trading_date, round(log_return, 6) AS log_return FROM intraday")
def _(spark, sf):
    return rounded(volatility.calculate_intraday_log_returns(bars(spark, sf)))


@registered("realized_volatility", f"{HOURLY} SELECT asset_id, trading_date, round(realized_variance, 6) AS realized_variance, round(realized_volatility, 6) AS realized_volatility, observation_count FROM rv")
def _(spark, sf):
    return rounded(volatility.compute_realized_volatility(bars(spark, sf)))


TARGET = "SELECT asset_id, trading_date, round(realized_volatility, 6) AS realized_volatility, round(target, 6) AS target FROM (SELECT *, lead(realized_volatility) OVER (PARTITION BY asset_id ORDER BY trading_date) AS target FROM rv) WHERE target IS NOT NULL"


@registered("next_day_target", f"{HOURLY} {TARGET}")
def _(spark, sf):
    return rounded(volatility.create_next_day_target(volatility.compute_realized_volatility(bars(spark, sf))))


@registered("research_dataset", f"""{HOURLY},
nxt AS (SELECT asset_id, trading_date, lead(realized_volatility) OVER (PARTITION BY asset_id ORDER BY trading_date) AS target
        FROM (SELECT l.asset_id, l.timestamp::DATE AS trading_date, max(v.realized_volatility) AS realized_volatility FROM lr l LEFT JOIN rv v ON v.asset_id = l.asset_id AND v.trading_date = l.timestamp::DATE WHERE r IS NOT NULL GROUP BY 1, 2))
SELECT l.timestamp, l.asset_id, round(l.r, 6) AS "return", round(v.realized_volatility, 6) AS realized_volatility, round(n.target, 6) AS target
FROM lr l JOIN rv v ON v.asset_id = l.asset_id AND v.trading_date = l.timestamp::DATE JOIN nxt n ON n.asset_id = l.asset_id AND n.trading_date = l.timestamp::DATE
WHERE l.r IS NOT NULL AND n.target IS NOT NULL""")
def _(spark, sf):
    return rounded(volatility.prepare_research_dataset(bars(spark, sf)).select("timestamp", "asset_id", "return", "realized_volatility", "target"))


def _rolling_sql() -> str:
    cols = []
    for w in features.WINDOWS:
        frame = f"(PARTITION BY asset_id ORDER BY timestamp ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        for name, what in ((f"rolling_volatility_{w}", ("stddev_samp(r)", "r")), (f"rolling_volume_{w}", ("avg(volume)", "volume")), (f"rolling_range_{w}", ("avg(rng)", "rng"))):
            cols.append(f"round(CASE WHEN count({what[1]}) OVER {frame} = {w} THEN {what[0]} OVER {frame} END, 6) AS {name}")
        cols.append(f"round(close / lag(close, {w}) OVER (PARTITION BY asset_id ORDER BY timestamp) - 1, 6) AS momentum_{w}")
    return f"{HOURLY} SELECT timestamp, asset_id, {', '.join(cols)} FROM (SELECT *, (high - low) / close AS rng FROM lr)"


@registered("rolling_features", _rolling_sql())
def _(spark, sf):
    return rounded(features.create_rolling_features(bars(spark, sf)))


_LAGGED = ", ".join(f"round(lag(r, {k}) OVER (PARTITION BY asset_id ORDER BY timestamp), 6) AS return_lag_{k}" for k in features.LAGS)
_LAGGED_VOL = ", ".join(f"round(lag(volume, {k}) OVER (PARTITION BY asset_id ORDER BY timestamp), 6) AS volatility_lag_{k}" for k in features.LAGS)


@registered("lagged_returns", f"{HOURLY} SELECT timestamp, asset_id, {_LAGGED} FROM lr")
def _(spark, sf):
    return rounded(features.create_lagged_returns(bars(spark, sf)))


@registered("lagged_volatility", f"{HOURLY} SELECT timestamp, asset_id, {_LAGGED_VOL} FROM lr")
def _(spark, sf):
    return rounded(features.create_lagged_volatility(bars(spark, sf), volatility_column="volume"))


@registered("lagged_features", f"{HOURLY} SELECT timestamp, asset_id, {_LAGGED}, {_LAGGED_VOL} FROM lr")
def _(spark, sf):
    return rounded(features.create_lagged_features(bars(spark, sf), volatility_column="volume"))


@registered("cross_asset_features", f"""{HOURLY}
SELECT a.timestamp, a.asset_id, round(avg(b.r), 6) AS cross_asset_mean_return, round(stddev_pop(b.r), 6) AS cross_asset_return_dispersion, round(avg(abs(b.r)), 6) AS cross_asset_mean_abs_return
FROM lr a LEFT JOIN lr b ON a.timestamp = b.timestamp AND a.asset_id <> b.asset_id AND b.r IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(features.create_cross_asset_features(bars(spark, sf)))


@registered("garch_feature_coverage", f"""{USABLE}
SELECT asset_id, count(*) AS rows_total, count(*) FILTER (volatility > 0.4) AS covered FROM ok GROUP BY 1""")
def _(spark, sf):
    rows = usable_panel(spark, sf)
    f = rows.filter("volatility > 0.4").select("timestamp", "asset_id", F.col("volatility").alias("garch_forecast"))
    gone = features.uncovered(rows, f).groupBy("asset_id").agg(F.count(F.lit(1)).alias("gone"))
    return rows.groupBy("asset_id").agg(F.count(F.lit(1)).alias("rows_total")).join(gone, "asset_id", "left").select("asset_id", "rows_total", (F.col("rows_total") - F.coalesce("gone", F.lit(0))).alias("covered"))


@registered("garch_feature_merge", f"{USABLE} SELECT timestamp, asset_id, round(\"return\", 6) AS \"return\", round(naive, 6) AS garch_forecast FROM ok")
def _(spark, sf):
    rows = usable_panel(spark, sf)
    f = rows.select("timestamp", "asset_id", F.col("naive").alias("garch_forecast"))
    return rounded(features.merge_garch_features(rows.select("timestamp", "asset_id", "return"), f))


# Folds and models ---------------------------------------------------------------

TRAIN, STEP = 120, 1


@registered("walk_forward_folds", f"""{USABLE},
cal AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS k FROM (SELECT DISTINCT timestamp FROM ok)),
folds AS (SELECT f AS fold_id FROM range(0, (SELECT (count(*) - {TRAIN} - 1) // {STEP} + 1 FROM cal)) t(f))
SELECT fold_id::INTEGER AS fold_id, a.timestamp AS train_start, b.timestamp AS train_end, c.timestamp AS test_start, c.timestamp AS test_end
FROM folds JOIN cal a ON a.k = fold_id * {STEP} JOIN cal b ON b.k = fold_id * {STEP} + {TRAIN} - 1 JOIN cal c ON c.k = fold_id * {STEP} + {TRAIN}""")
def _(spark, sf):
    return walkforward.fold_table(usable_panel(spark, sf), train_size=TRAIN, test_size=1, step_size=STEP)


FOLDS = f"""{USABLE},
cal AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS k FROM (SELECT DISTINCT timestamp FROM ok)),
folds AS (SELECT f AS fold_id FROM range(0, (SELECT (count(*) - {TRAIN} - 1) // {STEP} + 1 FROM cal)) t(f)),
placed AS (SELECT o.*, fold_id, CASE WHEN k < fold_id * {STEP} + {TRAIN} THEN 'train' ELSE 'test' END AS role FROM ok o JOIN cal USING (timestamp) JOIN folds ON k BETWEEN fold_id * {STEP} AND fold_id * {STEP} + {TRAIN})"""


@registered("fold_assignment", f"{FOLDS} SELECT fold_id::INTEGER AS fold_id, role, count(*) AS n, count(DISTINCT timestamp) AS days FROM placed GROUP BY 1, 2")
def _(spark, sf):
    rows = walkforward.assign_folds(usable_panel(spark, sf), train_size=TRAIN, test_size=1, step_size=STEP)
    return rows.groupBy(F.col("fold_id").cast("int").alias("fold_id"), "role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("timestamp").alias("days"))


@registered("ewma_walk_forward", f"""{FOLDS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY fold_id, asset_id ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY fold_id, asset_id) AS n FROM placed WHERE role = 'train'),
v AS (SELECT fold_id, asset_id, sqrt(max(pow(0.94, n)) * arg_min("return" * "return", i) + 0.06 * sum(pow(0.94, n - 1 - i) * "return" * "return")) AS prediction FROM numbered GROUP BY 1, 2)
SELECT p.timestamp, p.asset_id, round(v.prediction, 6) AS prediction, round(p.target, 6) AS actual_volatility, p.fold_id::INTEGER AS fold_id, 'EWMA' AS model FROM placed p JOIN v USING (fold_id, asset_id) WHERE role = 'test'""")
def _(spark, sf):
    return rounded(walkforward.run_model(usable_panel(spark, sf), "EWMA", train_size=TRAIN, test_size=1, step_size=STEP))


@registered("ewma_forecast", f"""{USABLE},
numbered AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY asset_id) AS n FROM ok)
SELECT asset_id, round(max(pow(0.94, n)) * arg_min("return" * "return", i) + 0.06 * sum(pow(0.94, n - 1 - i) * "return" * "return"), 6) AS ewma_variance, count(*) AS observations FROM numbered GROUP BY 1""")
def _(spark, sf):
    return rounded(ewma.calculate_ewma(usable_panel(spark, sf)).drop("ewma_volatility"))


def _wide_panel(spark, sf):
    """Columns of the panel as the models' features need them."""
    return usable_panel(spark, sf, "high", "low", "close").withColumnRenamed("volatility", "realized_volatility")


#: One-step forecasts of every date; blocks of 60 dates, all of them forecast; and one date in 60, for the queries that fit all models in every fold.
EVERY_DATE, BLOCKS, SPARSE = ({"train_size": TRAIN, "test_size": test, "step_size": step} for test, step in ((1, 1), (60, 60), (1, 60)))
TREE_FEATURES = ["return", "naive", "older"]


@registered("gjr_garch_walk_forward", None)
def _(spark, sf):
    return rounded(walkforward.run_model(_wide_panel(spark, sf), "GJR-GARCH", **EVERY_DATE))


@registered("boosted_trees_walk_forward", None)
def _(spark, sf):
    return rounded(walkforward.run_model(_wide_panel(spark, sf), "XGBoost", feature_columns=TREE_FEATURES, **BLOCKS))


@registered("regime_trees_walk_forward", None)
def _(spark, sf):
    out = walkforward.run_model(_wide_panel(spark, sf), "Regime-XGBoost", feature_columns=TREE_FEATURES, **SPARSE)
    return rounded(out.select("timestamp", "asset_id", "prediction", "actual_volatility", "fold_id", "model"))


@registered("ablations", None)
def _(spark, sf):
    return rounded(walkforward.run_ablations(_wide_panel(spark, sf), feature_columns=TREE_FEATURES, **SPARSE))


@registered("regime_probabilities", None)
def _(spark, sf):
    rows = walkforward.assign_folds(_wide_panel(spark, sf), **BLOCKS).withColumn("fold_id", F.col("fold_id").cast("int"))
    return rounded(walkforward.hmm_features(rows))


# Evaluation ---------------------------------------------------------------------

LONG = f"{USABLE},\nlong AS (SELECT timestamp, asset_id, 'naive' AS model, target AS actual, naive AS forecast FROM ok UNION ALL SELECT timestamp, asset_id, 'older', target, older FROM ok)"


def long_forecasts(spark, sf):
    p = usable_panel(spark, sf)
    both = F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("forecast")) for m in ("naive", "older")))
    return p.select("timestamp", "asset_id", F.col("target").alias("actual"), F.explode(both).alias("f")).select("timestamp", "asset_id", "f.model", "actual", "f.forecast")


@registered("forecast_metrics", f"""{LONG}
SELECT model, count(*) AS observations, round(avg(abs(actual - forecast)), 6) AS mae, round(sqrt(avg((actual - forecast) * (actual - forecast))), 6) AS rmse,
       round(avg(actual / forecast - ln(actual / forecast) - 1), 6) AS qlike, count(*) FILTER (actual <= 0 OR forecast <= 0) AS qlike_violations FROM long GROUP BY 1""")
def _(spark, sf):
    return rounded(evaluation.compare_forecasts(long_forecasts(spark, sf)))


@registered("loss_matrix", f"""{LONG}
SELECT timestamp, asset_id, round(max(l) FILTER (model = 'naive'), 6) AS naive, round(max(l) FILTER (model = 'older'), 6) AS older
FROM (SELECT *, actual / forecast - ln(actual / forecast) - 1 AS l FROM long) GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(evaluation.build_loss_matrix(long_forecasts(spark, sf), ["naive", "older"], observation=["timestamp", "asset_id"]))


_DM = f"""{USABLE},
d AS (SELECT timestamp, asset_id, (target - naive) * (target - naive) - (target - older) * (target - older) AS d FROM ok),
c AS (SELECT *, d - avg(d) OVER (PARTITION BY asset_id) AS c FROM d),
p AS (SELECT *, {", ".join(f"c * lag(c, {k}) OVER (PARTITION BY asset_id ORDER BY timestamp) AS p{k}" for k in (1, 2, 3, 4))} FROM c),
s AS (SELECT asset_id, count(*) AS n, avg(d) AS m, greatest(avg(c * c) + {" + ".join(f"{2 * (1 - k / 5)} * avg(p{k})" for k in (1, 2, 3, 4))}, 0) AS lrv FROM p GROUP BY 1)"""


@registered("diebold_mariano", f"{_DM} SELECT asset_id, n AS observations, 4 AS lag, round(m, 6) AS mean_difference, round(lrv, 6) AS long_run_variance, round(m / sqrt(lrv / n), 6) AS statistic FROM s")
def _(spark, sf):
    out = evaluation.diebold_mariano_test(usable_panel(spark, sf), actual="target", forecast_a="naive", forecast_b="older", lag=4, by=("asset_id",))
    return rounded(out.drop("p_value"))


@registered("pairwise_loss_statistics", f"""{LONG},
x AS (SELECT timestamp::VARCHAR || asset_id AS obs, model, (actual - forecast) * (actual - forecast) AS l FROM long)
SELECT a.model AS model_a, b.model AS model_b, count(*) AS n, round(avg(a.l - b.l), 6) AS mean_difference, round(avg(a.l - b.l) / (stddev_samp(a.l - b.l) / sqrt(count(*))), 6) AS t
FROM x a JOIN x b ON a.obs = b.obs AND a.model < b.model GROUP BY 1, 2""")
def _(spark, sf):
    x = long_forecasts(spark, sf).withColumn("obs", F.concat(F.col("timestamp").cast("string"), "asset_id"))
    return rounded(evaluation.pairwise_loss_statistics(x, observation="obs"))


@registered("hashed_bootstrap", f"""{USABLE},
x AS (SELECT row_number() OVER (ORDER BY timestamp, asset_id) - 1 AS pos, "return" AS x FROM ok),
n AS (SELECT count(*) AS n FROM x),
g AS MATERIALIZED (SELECT b, ('0x' || substr(md5('42:' || b::VARCHAR || ':' || k::VARCHAR), 1, 12))::BIGINT % n AS pos FROM range(0, 2000) t(b), (SELECT n, unnest(range(n)) AS k FROM n)),
m AS (SELECT b, avg(x.x) AS m FROM g JOIN x USING (pos) GROUP BY 1)
SELECT round((SELECT avg(x) FROM x), 6) AS estimate, (SELECT n FROM n) AS observations, round(quantile_cont(m, 0.025), 6) AS "lower", round(quantile_cont(m, 0.975), 6) AS "upper", round(stddev_samp(m), 6) AS standard_error FROM m""")
def _(spark, sf):
    return rounded(resampling.hashed_bootstrap(usable_panel(spark, sf), "return", ("timestamp", "asset_id")))


@registered("bootstrap_intervals", None)
def _(spark, sf):
    return rounded(resampling.grouped_bootstrap(usable_panel(spark, sf), "return", ("asset_id",), n_bootstrap=2000))


def _confidence_set_sql(replications: int) -> str:
    return f"""{USABLE},
x AS (SELECT asset_id, row_number() OVER w - 1 AS i, pow(target - naive, 2) AS l0, pow(target - older, 2) AS l1, count(*) OVER (PARTITION BY asset_id) AS n FROM ok WINDOW w AS (PARTITION BY asset_id ORDER BY timestamp)),
g AS (SELECT asset_id, max(n) AS n, avg(l0) AS m0, avg(l1) AS m1, ceil(sqrt(max(n)))::BIGINT AS block, floor(sqrt(max(n)))::BIGINT AS lags FROM x GROUP BY 1),
c AS (SELECT asset_id, i, l0 - l1 - (m0 - m1) AS c FROM x JOIN g USING (asset_id)),
k AS MATERIALIZED (SELECT asset_id, k, lags, c, i - k AS i FROM (SELECT asset_id, i, c, lags, unnest(range(0, lags + 1)) AS k FROM c JOIN g USING (asset_id)) WHERE i >= k),
gam AS (SELECT k.asset_id, k.k, max(k.lags) AS lags, avg(k.c * b.c) AS gamma FROM k JOIN c b ON b.asset_id = k.asset_id AND b.i = k.i GROUP BY 1, 2),
se AS (SELECT asset_id, sqrt(greatest(sum(CASE WHEN k = 0 THEN gamma ELSE 2 * (1 - k / (gam.lags + 1)) * gamma END), 2.220446049250313e-16) / max(n)) AS se FROM gam JOIN g USING (asset_id) GROUP BY 1),
pre AS (SELECT asset_id, i + 1 AS at, sum(c) OVER (PARTITION BY asset_id ORDER BY i) AS s FROM c UNION ALL SELECT asset_id, 0, 0 FROM g),
r AS (SELECT asset_id, n, block, b, unnest(range(0, ceil(n / block)::BIGINT)) AS r FROM g, range(0, {replications}) t(b)),
st AS (SELECT asset_id, b, ('0x' || substr(md5('42:' || b::VARCHAR || ':' || r::VARCHAR), 1, 12))::BIGINT % (n - block + 1) AS start, least(block, n - r * block) AS len FROM r),
d AS (SELECT st.asset_id, b, sum(e.s - f.s) AS s FROM st JOIN pre e ON e.asset_id = st.asset_id AND e.at = st.start + len JOIN pre f ON f.asset_id = st.asset_id AND f.at = st.start GROUP BY 1, 2),
p AS (SELECT g.asset_id, max(m0) AS m0, max(m1) AS m1, (1 + count(*) FILTER (abs(d.s / n) / se >= abs(m0 - m1) / se)) / ({replications} + 1) AS p FROM d JOIN g USING (asset_id) JOIN se USING (asset_id) GROUP BY 1)
SELECT asset_id, 'naive' AS model, p > 0.1 OR m0 < m1 AS included, round(p, 6) AS p_value FROM p UNION ALL SELECT asset_id, 'older', p > 0.1 OR m1 <= m0, round(p, 6) FROM p"""


@registered("model_confidence_set", _confidence_set_sql(2000))
def _(spark, sf):
    wide = evaluation.build_loss_matrix(long_forecasts(spark, sf), ["naive", "older"], observation=["timestamp", "asset_id"], kind="squared")
    return rounded(resampling.distributed_confidence_set(wide, ["naive", "older"], ("asset_id",), n_bootstrap=2000))


@registered("model_confidence_set_by_generator", None)
def _(spark, sf):
    wide = evaluation.build_loss_matrix(long_forecasts(spark, sf), ["naive", "older"], observation=["timestamp", "asset_id"], kind="squared")
    return rounded(resampling.grouped_model_confidence_set(wide, ["naive", "older"], ("asset_id",), n_bootstrap=2000))


# Risk ---------------------------------------------------------------------------


@registered("value_at_risk", f"{USABLE} SELECT asset_id, round(-quantile_cont(\"return\", 0.05), 6) AS var_95, round(-quantile_cont(\"return\", 0.01), 6) AS var_99, count(*) AS observations FROM ok GROUP BY 1")
def _(spark, sf):
    return rounded(risk.calculate_required_var_levels(usable_panel(spark, sf), "return", by=("asset_id",)))


@registered("expected_shortfall", f"""{USABLE},
q AS (SELECT asset_id, l AS confidence_level, CASE WHEN l = 0.95 THEN quantile_cont("return", 0.05) ELSE quantile_cont("return", 0.01) END AS cut FROM ok, (VALUES (0.95::DOUBLE), (0.99::DOUBLE)) t(l) GROUP BY 1, 2)
SELECT asset_id, confidence_level, round(-cut, 6) AS value_at_risk, round(-avg("return"), 6) AS expected_shortfall, count(*) AS tail_count FROM ok JOIN q USING (asset_id) WHERE "return" <= cut GROUP BY asset_id, confidence_level, cut""")
def _(spark, sf):
    return rounded(risk.calculate_required_es_levels(usable_panel(spark, sf), "return", by=("asset_id",)))


BACKTEST = f"{USABLE},\nbt AS (SELECT timestamp, asset_id, \"return\" <= -0.5 * naive AS e FROM ok)"


def backtest_rows(spark, sf):
    return usable_panel(spark, sf).select("timestamp", "asset_id", F.col("return").alias("actual_return"), (F.col("naive") * 0.5).alias("var_loss"))


@registered("var_exceptions", f"{BACKTEST} SELECT asset_id, count(*) AS observation_count, count(*) FILTER (e) AS exception_count, round(avg(e::INTEGER), 6) AS exception_rate, 0::BIGINT AS invalid_var FROM bt GROUP BY 1")
def _(spark, sf):
    return rounded(risk.prepare_var_backtest(backtest_rows(spark, sf), by=("asset_id",)))


#: erfc of a result in SQL: the series where it is accurate, 0 to six decimals beyond.
_ERFC = "CASE WHEN {x} > 4 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda k: CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * exp((2 * k + 1) * ln(greatest({x}, 1e-300)) - lgamma(k + 1)) / (2 * k + 1))) END"


def _chi2_1(x: str) -> str:
    return _ERFC.format(x=f"sqrt({x} / 2)")


_UC = "greatest(-2 * ((CASE WHEN x = 0 THEN 0 ELSE x * ln(0.05) END + CASE WHEN n = x THEN 0 ELSE (n - x) * ln(0.95) END) - (CASE WHEN x = 0 THEN 0 ELSE x * ln(x / n) END + CASE WHEN n = x THEN 0 ELSE (n - x) * ln(1 - x / n) END)), 0)"


@registered("kupiec", f"""{BACKTEST},
s AS (SELECT asset_id, count(*) AS n, count(*) FILTER (e) AS x FROM bt GROUP BY 1), u AS (SELECT *, {_UC} AS lr FROM s)
SELECT asset_id, n AS observation_count, x AS exception_count, round(x / n, 6) AS exception_rate, 0.95::DOUBLE AS confidence_level, round(lr, 6) AS lr_uc, round({_chi2_1('lr')}, 6) AS p_value, {_chi2_1('lr')} < 0.05 AS reject FROM u""")
def _(spark, sf):
    out = risk.kupiec_95(backtest_rows(spark, sf), by=("asset_id",))
    return rounded(out.select("asset_id", "observation_count", "exception_count", "exception_rate", "confidence_level", "lr_uc", "p_value", "reject"))


def _ll(n: str, p: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0 ELSE {n} * ln({p}) END"


@registered("christoffersen", f"""{BACKTEST},
m AS (SELECT *, lag(e) OVER (PARTITION BY asset_id ORDER BY timestamp) AS b FROM bt),
t AS (SELECT asset_id, count(*) AS n, count(*) FILTER (e) AS x, count(*) FILTER (NOT b AND NOT e) AS n00, count(*) FILTER (NOT b AND e) AS n01, count(*) FILTER (b AND NOT e) AS n10, count(*) FILTER (b AND e) AS n11 FROM m GROUP BY 1),
u AS (SELECT *, n01 / (n00 + n01) AS p01, n11 / (n10 + n11) AS p11, (n01 + n11) / (n00 + n01 + n10 + n11) AS p, {_UC} AS lr_uc FROM t),
w AS (SELECT *, greatest(-2 * ({_ll('(n01 + n11)', 'p')} + {_ll('(n00 + n10)', '(1 - p)')} - ({_ll('n01', 'p01')} + {_ll('n00', '(1 - p01)')} + {_ll('n11', 'p11')} + {_ll('n10', '(1 - p11)')})), 0) AS lr_ind FROM u)
SELECT asset_id, n00, n01, n10, n11, round(lr_ind, 6) AS lr_ind, round(lr_uc, 6) AS lr_uc, round(lr_ind + lr_uc, 6) AS lr_cc, round({_chi2_1('lr_ind')}, 6) AS p_ind, round(exp(-(lr_ind + lr_uc) / 2), 6) AS p_cc FROM w""")
def _(spark, sf):
    out = risk.christoffersen_95(backtest_rows(spark, sf), by=("asset_id",))
    return rounded(out.select("asset_id", "n00", "n01", "n10", "n11", "lr_ind", "lr_uc", "lr_cc", "p_ind", "p_cc"))


@registered("filtered_historical_simulation", f"""{USABLE},
z AS (SELECT asset_id, "return" / naive AS z FROM ok) SELECT asset_id, count(*) AS observations, round(avg(z), 6) AS mean_z, round(stddev_samp(z), 6) AS sd_z FROM z GROUP BY 1""")
def _(spark, sf):
    z = risk.standardized_returns(usable_panel(spark, sf).withColumn("forecast_volatility", F.col("naive")), by=("asset_id",))
    return rounded(z.groupBy("asset_id").agg(F.count(F.lit(1)).alias("observations"), F.avg("z").alias("mean_z"), F.stddev_samp("z").alias("sd_z")))


@registered("simulated_tail_risk", None)
def _(spark, sf):
    draws = risk.filtered_historical_simulation(usable_panel(spark, sf).withColumn("forecast_volatility", F.col("naive")), 0.5)
    return rounded(risk.calculate_required_es_levels(draws))


# Portfolio ----------------------------------------------------------------------

WEIGHTS = f"{USABLE},\nw AS (SELECT timestamp, asset_id, \"return\", greatest(-0.8, least(0.8, 0.1 / naive)) AS weight FROM ok)"


def weights(spark, sf):
    base = usable_panel(spark, sf).select("timestamp", "asset_id", "return", F.col("naive").alias("forecast_volatility"), F.lit(1.0).alias("base_weight"))
    return portfolio.calculate_risk_targeted_weights(base, target_volatility=0.1, max_position=0.8).withColumnRenamed("target_weight", "weight")


@registered("risk_targeted_weights", f"{WEIGHTS} SELECT timestamp, asset_id, round(weight, 6) AS weight FROM w")
def _(spark, sf):
    return rounded(weights(spark, sf).select("timestamp", "asset_id", "weight"))


@registered("position_limits", f"{WEIGHTS} SELECT timestamp, asset_id, round(greatest(-0.15, least(0.15, weight)), 6) AS weight FROM w")
def _(spark, sf):
    return rounded(portfolio.apply_position_limits(weights(spark, sf).select("timestamp", "asset_id", "weight"), max_position=0.15, column="weight"))


RETURNS = f"{WEIGHTS},\npr AS (SELECT timestamp, sum(weight * \"return\") AS portfolio_return, sum(abs(weight)) AS gross_exposure, sum(weight) AS net_exposure, count(*) AS asset_count FROM w GROUP BY 1)"


def portfolio_returns(spark, sf):
    w = weights(spark, sf)
    return portfolio.calculate_portfolio_returns(w, w)


@registered("portfolio_returns", f"{RETURNS} SELECT timestamp, round(portfolio_return, 6) AS portfolio_return, round(gross_exposure, 6) AS gross_exposure, round(net_exposure, 6) AS net_exposure, asset_count FROM pr")
def _(spark, sf):
    return rounded(portfolio_returns(spark, sf))


@registered("static_weights", f"{USABLE} SELECT timestamp, asset_id, CASE asset_id WHEN 'A' THEN 0.6 WHEN 'N' THEN 0.4 ELSE 0 END::DOUBLE AS weight FROM ok")
def _(spark, sf):
    return portfolio.create_static_weights(usable_panel(spark, sf), {"A": 0.6, "N": 0.4})


#: Returns of a thousandth keep the wealth of these synthetic prices finite.
SCALED = f"{RETURNS},\nsm AS (SELECT timestamp, portfolio_return / 1000 AS r FROM pr),\nwl AS (SELECT *, product(1 + r) OVER (ORDER BY timestamp) AS wealth FROM sm),\ndd AS (SELECT *, wealth / max(wealth) OVER (ORDER BY timestamp) - 1 AS drawdown FROM wl)"


@registered("performance", f"""{SCALED},
b AS (SELECT count(*) AS observations, product(1 + r) - 1 AS total_return, stddev_samp(r) * sqrt(252) AS annualized_volatility, sqrt(avg(pow(least(r, 0), 2))) * sqrt(252) AS downside_deviation, min(drawdown) AS max_drawdown FROM dd),
g AS (SELECT *, pow(1 + total_return, 252 / observations) - 1 AS annualized_return FROM b)
SELECT observations, round(total_return, 6) AS total_return, round(annualized_return, 6) AS annualized_return, round(annualized_volatility, 6) AS annualized_volatility, round(annualized_return / annualized_volatility, 6) AS sharpe_ratio,
       round(downside_deviation, 6) AS downside_deviation, round(annualized_return / downside_deviation, 6) AS sortino_ratio, round(max_drawdown, 6) AS max_drawdown, round(annualized_return / -max_drawdown, 6) AS calmar_ratio FROM g""")
def _(spark, sf):
    small = portfolio_returns(spark, sf).withColumn("portfolio_return", F.col("portfolio_return") / 1000)
    return rounded(portfolio.calculate_performance(small))


TURNOVER = f"""{WEIGHTS},
dt AS (SELECT timestamp, lead(timestamp) OVER (ORDER BY timestamp) AS nxt FROM (SELECT DISTINCT timestamp FROM w)),
prev AS (SELECT nxt AS timestamp, asset_id, weight FROM w JOIN dt USING (timestamp) WHERE nxt IS NOT NULL),
to_ AS (SELECT timestamp, sum(abs(coalesce(w.weight, 0) - coalesce(prev.weight, 0))) AS turnover FROM w FULL JOIN prev USING (timestamp, asset_id) GROUP BY 1)"""


@registered("turnover", f"{TURNOVER} SELECT timestamp, round(turnover, 6) AS turnover FROM to_")
def _(spark, sf):
    return rounded(portfolio.turnover_by_time(weights(spark, sf)))


def _two_books(spark, sf):
    w = weights(spark, sf)
    now, before = (w.filter(F.year("timestamp") == y).groupBy("asset_id").agg(F.avg("weight").alias("target_weight")) for y in (1996, 1994))
    return now, before.filter("asset_id <> 'N'").unionByName(before.filter("asset_id = 'N'").withColumn("asset_id", F.lit("OLD")))


BOOKS = f"""{WEIGHTS},
now AS (SELECT asset_id, avg(weight) AS n FROM w WHERE year(timestamp) = 1996 GROUP BY 1),
bef AS (SELECT CASE asset_id WHEN 'N' THEN 'OLD' ELSE asset_id END AS asset_id, avg(weight) AS b FROM w WHERE year(timestamp) = 1994 GROUP BY 1),
sides AS (SELECT asset_id, coalesce(n, 0) AS n, coalesce(b, 0) AS b FROM now FULL JOIN bef USING (asset_id))"""


@registered("turnover_between_books", f"{BOOKS} SELECT round(sum(abs(n - b)), 6) AS turnover, count(*) AS asset_count FROM sides")
def _(spark, sf):
    return rounded(portfolio.calculate_turnover(*_two_books(spark, sf)))


@registered("turnover_limit", f"{BOOKS}, t AS (SELECT sum(abs(n - b)) AS total FROM sides) SELECT asset_id, round(b + (n - b) * CASE WHEN total > 0.05 THEN 0.05 / total ELSE 1 END, 6) AS target_weight FROM sides, t")
def _(spark, sf):
    now, before = _two_books(spark, sf)
    return rounded(portfolio.apply_turnover_limit(now, before, max_turnover=0.05))


@registered("sequential_constraints", WEIGHTS.replace("WITH", "WITH RECURSIVE", 1) + """,
steps AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) AS k FROM (SELECT DISTINCT timestamp FROM w)),
grid AS (SELECT d.k, d.timestamp, a.asset_id, w.weight AS target FROM steps d CROSS JOIN (SELECT DISTINCT asset_id FROM w) a LEFT JOIN w USING (timestamp, asset_id)),
books AS (SELECT k, timestamp, list(asset_id ORDER BY asset_id) AS names, list(coalesce(target, 0) ORDER BY asset_id) AS want, list(target IS NOT NULL ORDER BY asset_id) AS named FROM grid GROUP BY 1, 2),
path AS (
  SELECT 0::BIGINT AS k, [0.0::DOUBLE for x in want] AS held, [false for x in want] AS shown, 0.0::DOUBLE AS turnover FROM books WHERE k = 1
  UNION ALL
  SELECT k, [x[1] + (x[2] - x[1]) * scale for x in list_zip(held, want)], [x[1] or x[2] <> 0 for x in list_zip(named, held)], total * scale
  FROM (SELECT *, CASE WHEN total > 0.2 THEN 0.2 / total ELSE 1.0::DOUBLE END AS scale
        FROM (SELECT b.k, p.held, b.want, b.named, list_sum([abs(x[2] - x[1]) for x in list_zip(p.held, b.want)]) AS total FROM path p JOIN books b ON b.k = p.k + 1)))
SELECT 'book' AS portfolio_id, timestamp, asset_id, round(weight, 6) AS weight, round(turnover, 6) AS turnover
FROM (SELECT b.timestamp, unnest(b.names) AS asset_id, unnest(p.held) AS weight, unnest(p.shown) AS shown, p.turnover FROM path p JOIN books b USING (k)) WHERE shown""")
def _(spark, sf):
    w = weights(spark, sf).select(F.lit("book").alias("portfolio_id"), "timestamp", "asset_id", F.col("weight").alias("target_weight"))
    return rounded(portfolio.sequential_constraints(w, max_position=0.8, max_turnover=0.2))


COSTS = f"{TURNOVER},\nct AS (SELECT t.timestamp, t.turnover, p.gross AS gross_return FROM to_ t JOIN (SELECT timestamp, sum(weight * \"return\") AS gross FROM w GROUP BY 1) p USING (timestamp))"


def cost_rows(spark, sf):
    w = weights(spark, sf)
    return portfolio.turnover_by_time(w).join(portfolio.calculate_portfolio_returns(w, w).select("timestamp", F.col("portfolio_return").alias("gross_return")), "timestamp")


@registered("net_returns", f"{COSTS} SELECT timestamp, round(turnover, 6) AS turnover, round(gross_return, 6) AS gross_return, round(turnover * 0.001, 6) AS transaction_cost, round(gross_return - turnover * 0.001, 6) AS net_return FROM ct")
def _(spark, sf):
    return rounded(portfolio.calculate_net_returns(cost_rows(spark, sf), cost_rate=0.001))


@registered("cost_sensitivity", f"""{COSTS}
SELECT rate::DOUBLE AS cost_rate, count(*) AS observation_count, round(sum(turnover), 6) AS total_turnover, round(sum(gross_return), 6) AS total_gross_return, round(sum(turnover) * rate, 6) AS total_transaction_cost, round(sum(gross_return) - sum(turnover) * rate, 6) AS total_net_return
FROM ct, (VALUES (0.0::DOUBLE), (0.0004::DOUBLE), (0.001::DOUBLE), (0.002::DOUBLE)) t(rate) GROUP BY rate""")
def _(spark, sf):
    return rounded(portfolio.calculate_cost_sensitivity(cost_rows(spark, sf), cost_rates=(0.0, 0.0004, 0.001, 0.002)))


# Stress -------------------------------------------------------------------------

STRESS = f"{USABLE},\nst AS (SELECT timestamp, asset_id, ln(1 + \"return\") / 100 AS r, volatility AS v FROM ok),\nq AS (SELECT quantile_cont(v, 0) AS q0, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.9) AS q90, quantile_cont(v, 0.99) AS q99 FROM st)"


def stress_rows(spark, sf):
    return usable_panel(spark, sf).select("timestamp", "asset_id", (F.log(1 + F.col("return")) / 100).alias("return"), "volatility", F.when(F.col("volatility") > F.col("naive"), 1).otherwise(0).alias("regime"))


@registered("high_volatility", f"{STRESS} SELECT timestamp, asset_id, round(v, 6) AS volatility FROM st, q WHERE v >= q90")
def _(spark, sf):
    return rounded(stress.identify_high_volatility(stress_rows(spark, sf)).select("timestamp", "asset_id", "volatility"))


ISLANDS = """,
wl AS (SELECT *, product(1 + r) OVER (PARTITION BY asset_id ORDER BY timestamp) AS wealth FROM st),
dd AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY asset_id ORDER BY timestamp) - 1 AS drawdown FROM wl),
fl AS (SELECT *, drawdown <= -0.02 AS deep FROM dd),
rn AS (SELECT *, sum(CASE WHEN deep IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY timestamp) AS run FROM (SELECT *, lag(deep) OVER (PARTITION BY asset_id ORDER BY timestamp) AS before FROM fl)),
pd_ AS (SELECT *, count(*) OVER (PARTITION BY asset_id, run) AS duration FROM rn)"""


@registered("prolonged_drawdowns", f"{STRESS}{ISLANDS} SELECT timestamp, asset_id, round(drawdown, 6) AS drawdown, duration FROM pd_ WHERE deep AND duration >= 5")
def _(spark, sf):
    return rounded(stress.identify_prolonged_drawdowns(stress_rows(spark, sf), minimum_drawdown=-0.02).select("timestamp", "asset_id", "drawdown", "duration"))


@registered("regime_transitions", f"""{USABLE}
SELECT timestamp, asset_id, regime, previous_regime FROM (SELECT *, lag(regime) OVER (PARTITION BY asset_id ORDER BY timestamp) AS previous_regime FROM (SELECT *, CASE WHEN volatility > naive THEN 1 ELSE 0 END AS regime FROM ok))
WHERE previous_regime IS NOT NULL AND regime <> previous_regime""")
def _(spark, sf):
    return stress.identify_regime_transitions(stress_rows(spark, sf)).select("timestamp", "asset_id", "regime", "previous_regime")


SCENARIOS = f"""{STRESS}{ISLANDS},
sc AS (
  SELECT 'normal_volatility' AS scenario, timestamp, asset_id, r FROM st, q WHERE v BETWEEN q0 AND q50
  UNION ALL SELECT 'high_volatility', timestamp, asset_id, r FROM st, q WHERE v >= q90
  UNION ALL SELECT 'volatility_spikes', timestamp, asset_id, r FROM st, q WHERE v >= q99
  UNION ALL SELECT 'prolonged_drawdowns', timestamp, asset_id, r FROM pd_ WHERE deep AND duration >= 5
  UNION ALL SELECT 'year_1995', timestamp, asset_id, r FROM st WHERE year(timestamp) = 1995)"""
SCENARIO_NAMES = ("normal_volatility", "high_volatility", "volatility_spikes", "prolonged_drawdowns", "year_1995", "nothing")


def scenarios(spark, sf):
    return stress.build_stress_scenarios(stress_rows(spark, sf), minimum_drawdown=-0.02, historical_windows=[("year_1995", "1995-01-01", "1995-12-31")])


@registered("stress_scenarios", f"""{SCENARIOS} SELECT n.scenario, count(sc.timestamp) AS observation_count, count(DISTINCT asset_id) AS asset_count, min(timestamp) AS start, max(timestamp) AS "end"
FROM (VALUES {", ".join(f"('{n}')" for n in SCENARIO_NAMES)}) n(scenario) LEFT JOIN sc USING (scenario) GROUP BY 1""")
def _(spark, sf):
    return stress.summarize_scenarios(scenarios(spark, sf), stress.scenario_names(spark, SCENARIO_NAMES))


RESULTS = f"""{SCENARIOS},
swl AS (SELECT *, product(1 + r) OVER (PARTITION BY scenario ORDER BY timestamp, asset_id) AS swealth FROM sc),
sdd AS (SELECT *, swealth / max(swealth) OVER (PARTITION BY scenario ORDER BY timestamp, asset_id) - 1 AS sdraw FROM swl),
rs AS (SELECT scenario, count(*) AS observation_count, count(DISTINCT asset_id) AS asset_count, sum(r) AS total_return, avg(r) AS mean_return, coalesce(stddev_samp(r), 0) * sqrt(252) AS volatility,
  sqrt(avg(pow(least(r, 0), 2))) * sqrt(252) AS downside_deviation, min(sdraw) AS max_drawdown, product(1 + r) - 1 AS cumulative_return FROM sdd GROUP BY 1)"""
_M = ("total_return", "mean_return", "volatility", "downside_deviation", "max_drawdown", "cumulative_return")
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in _M)


@registered("stress_results", f"{RESULTS} SELECT scenario, observation_count, asset_count, {_ROUNDED} FROM rs")
def _(spark, sf):
    return rounded(stress.run_stress_scenarios(scenarios(spark, sf)))


@registered("stress_analysis", f"""{RESULTS} SELECT scenario, observation_count, asset_count, {_ROUNDED}, {", ".join(f"round({m} - avg({m}) OVER (), 6) AS {m}_change_vs_mean" for m in _M)} FROM rs""")
def _(spark, sf):
    return rounded(stress.analyze_stress_results(stress.run_stress_scenarios(scenarios(spark, sf))))


@registered("stress_changes", f"""{RESULTS} SELECT rs.scenario, {", ".join(f"round(rs.{m} - ref.{m}, 6) AS {m}_change" for m in _M)} FROM rs, (SELECT * FROM rs WHERE scenario = 'normal_volatility') ref""")
def _(spark, sf):
    out = stress.calculate_stress_changes(stress.run_stress_scenarios(scenarios(spark, sf)), reference_scenario="normal_volatility")
    return rounded(out.select("scenario", *(f"{m}_change" for m in stress.METRICS)))


@registered("stress_table", f"""{RESULTS} SELECT scenario, observation_count > 0 AS has_observations, round(total_return / observation_count, 6) AS return_per_observation, round(abs(max_drawdown), 6) AS drawdown_magnitude,
round(volatility / abs(cumulative_return), 6) AS volatility_to_return FROM rs""")
def _(spark, sf):
    out = stress.build_stress_analysis_table(stress.run_stress_scenarios(scenarios(spark, sf)))
    return rounded(out.select("scenario", "has_observations", "return_per_observation", "drawdown_magnitude", "volatility_to_return"))
