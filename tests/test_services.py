import datetime as dt
import hashlib
import http.server
import json
import threading
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltrace.operators import resampling
from voltrace.sources import market_api

START = dt.datetime(2024, 1, 1)


def values(n, start=START):
    return [{"datetime": str(start + dt.timedelta(hours=k)), "open": f"{k}.5", "high": str(k + 1), "low": str(k), "close": f"{k}.25", "volume": None if k % 2 else "7"} for k in range(n)]


def test_recorded_responses(spark, tmp_path):
    lines = [{"meta": {"symbol": " ab "}, "values": values(3), "status": "ok"}, {"meta": {"symbol": "AB"}, "values": values(2, START + dt.timedelta(hours=2)), "status": "ok"},
             {"code": 404, "status": "error", "message": "none"}, {"meta": {"symbol": "C"}, "values": [], "status": "ok"}, {"meta": {"symbol": "D"}, "values": [{"datetime": "no date", "open": "x"}], "status": "ok"}]
    spark.createDataFrame([(json.dumps(x),) for x in lines], "value string").write.text(f"{tmp_path}/ok")
    got = market_api.load_responses(spark, f"{tmp_path}/ok")
    assert {(r.asset_id, r.timestamp.hour) for r in got.collect()} == {("AB", k) for k in range(4)} and got.count() == 4
    again = market_api.load_responses(spark, market_api.save_responses(got, f"{tmp_path}/again"))
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    assert market_api.load_responses(spark, market_api.save_responses(got.limit(0), f"{tmp_path}/none")).count() == 0
    for k, bad in enumerate(({"code": 401, "status": "error", "message": "no key"}, "no response")):
        spark.createDataFrame([(json.dumps(bad),)], "value string").write.text(f"{tmp_path}/bad{k}")
        with pytest.raises(Exception, match="no values in"):
            market_api.load_responses(spark, f"{tmp_path}/bad{k}").collect()


class Service(http.server.BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        asked = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
        at, end = (dt.datetime.fromisoformat(asked[k]) for k in ("start_date", "end_date"))
        body = {"status": "ok", "values": [v for v in values(48) if at <= dt.datetime.fromisoformat(v["datetime"]) <= end]} if asked["symbol"] == "AB" else {"status": "error", "code": 404}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *args):
        pass


def test_market_series_reads_a_service(spark):
    """Partitions ask a server on this machine; values at the ranges' common ends come once."""
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        try:
            got = market_api.load_market_series(spark, "ab,none", "hourly", "2024-01-01", "2024-01-02T23:00:00", base_url=f"http://127.0.0.1:{server.server_address[1]}", partitions=2)
            rows = got.orderBy("timestamp").collect()
        finally:
            server.shutdown()
    assert [(r.asset_id, r.close) for r in rows] == [("AB", k + 0.25) for k in range(48)]
    assert [r.volume for r in rows[:2]] == [7.0, None]


def test_hashed_sharpe_and_difference_against_loops(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0.1, 1, 60)
    df = spark.createDataFrame([(k, float(v), float(v) * 2) for k, v in enumerate(x)], "k long, x double, y double").withColumn("y", F.when(F.col("k") < 50, F.col("y")))

    def draws(v, value):
        n = len(v)
        return [value(v[[int(hashlib.md5(f"42:{b}:{k}".encode()).hexdigest()[:12], 16) % n for k in range(n)]]) for b in range(200)]

    def sharpe(v):
        return v.mean() / v.std(ddof=1) * np.sqrt(252)

    got = resampling.hashed_bootstrap(df, "x", ("k",), n_bootstrap=200, statistic="sharpe").first()
    want = draws(x, sharpe)
    assert np.allclose([got.estimate, got.lower, got.upper, got.standard_error], [sharpe(x), *np.quantile(want, [0.025, 0.975]), np.std(want, ddof=1)])
    got = resampling.hashed_bootstrap_difference(df, "x", "y", ("k",), n_bootstrap=200).first()
    want = draws(-x[:50], np.mean)
    assert got.observations == 50 and np.allclose([got.estimate, got.lower, got.upper], [-x[:50].mean(), *np.quantile(want, [0.025, 0.975])])
    flat = resampling.hashed_bootstrap(df.withColumn("x", F.lit(1.0)), "x", ("k",), n_bootstrap=100, statistic="sharpe").first()
    assert (flat.estimate, flat.lower, flat.upper) == (0.0, 0.0, 0.0)
    with pytest.raises(resampling.ResamplingError):
        resampling.hashed_bootstrap(df, "x", ("k",), statistic="median")
