import datetime as dt

import pytest

from voltrace.sources import contract, files
from voltrace.sources.market_api import Client, MarketApiError, normalize_interval, values_to_dataframe
from voltrace.sources.registry import AmbiguousRecordError, RecordExistsError, RecordNotFoundError, Registry

T0 = dt.datetime(2024, 1, 2, 9, 30)
COLS = "timestamp timestamp, asset_id string, open double, high double, low double, close double, volume double"


def rows(spark, *extra):
    good = [(T0 + dt.timedelta(hours=k), " aapl ", 10.0, 11.0, 9.0, 10.5, 100.0) for k in range(4)]
    return spark.createDataFrame([*good, *extra], COLS)


def test_canonical_columns_and_metadata(spark):
    df = contract.to_canonical(rows(spark).withColumnRenamed("volume", "volume"))
    contract.assert_canonical_schema(df)
    m = contract.dataset_metadata(df).first()
    assert (m.asset_ids, m.row_count, m.start) == (["AAPL"], 4, T0)
    with pytest.raises(contract.ContractError):
        contract.to_canonical(df.drop("open"))


def test_validation_counts_each_rule(spark):
    bad = [
        (T0, "AAPL", 10.0, 11.0, 9.0, 10.5, 100.0),  # repeats a key
        (T0, "B", 10.0, 9.0, 11.0, 10.0, -1.0),
        (T0, "C", 0.0, 1.0, 0.0, float("inf"), 0.0),
        (None, "D", 1.0, 1.0, 1.0, 1.0, 1.0),
    ]
    got = {r.rule: r.n for r in contract.validate_ohlcv(contract.canonical_columns(rows(spark, *bad))).collect()}
    assert got["duplicate_key"] == 2 and got["ohlc_relationship"] == 2 and got["negative_volume"] == 1 and got["zero_volume"] == 1
    assert got["null_timestamp"] == 1 and got["infinite_close"] == 1 and got["non_positive_open"] == 1 and got["non_positive_low"] == 1
    with pytest.raises(contract.ContractError, match="duplicate_key: 2"):
        contract.to_canonical(rows(spark, *bad))


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = rows(spark)
    a, b = contract.fingerprint_dataframe(df), contract.fingerprint_dataframe(df.orderBy("timestamp", ascending=False).repartition(3))
    assert a == b and contract.verify_fingerprint(df, f" {a.sha256.upper()} ")
    changed = contract.fingerprint_dataframe(df.withColumn("close", df.close + 1e-9))
    assert changed.sha256 != a.sha256
    assert contract.fingerprint_stream(contract.to_canonical(df)) == contract.fingerprint_stream(contract.to_canonical(df.repartition(2)))


def test_round_trips(spark, tmp_path):
    df = rows(spark)
    made = files.canonicalize_and_save(df, f"{tmp_path}/a.parquet")
    assert made.row_count == 4
    back = files.load_and_verify_parquet(spark, f"{tmp_path}/a.parquet")
    assert contract.fingerprint_dataframe(back) == contract.fingerprint_dataframe(df)
    files.save_csv(df, f"{tmp_path}/a.csv")
    assert contract.fingerprint_dataframe(files.load_csv(spark, f"{tmp_path}/a.csv")) == contract.fingerprint_dataframe(df)
    assert sum(len(c) for c in files.load_csv_chunks(spark, f"{tmp_path}/a.csv", chunksize=3)) == 4
    with pytest.raises(contract.ContractError):
        files.save_csv(df, f"{tmp_path}/a.txt")
    raw = files.load_raw_dataset(spark, f"{tmp_path}/a.parquet", assets=["aapl"], start="2024-01-02 10:00:00")
    assert raw.count() == 3
    paths = files.save_experiment_artifacts("my run", {"at": T0}, df, output_directory=str(tmp_path))
    assert files.load_json_artifact(paths["metadata"]) == {"at": T0.isoformat()} and files.load_experiment_results(spark, "my run", output_directory=str(tmp_path)).count() == 4


def test_registry(spark, tmp_path):
    reg = Registry(spark, str(tmp_path))
    reg.initialize()
    reg.save_dataset({"name": "d", "assets": ["A", "B"], "metadata": {"x": 1}})
    assert reg.get_dataset("d")["assets"] == ["A", "B"] and reg.list_datasets().count() == 1
    with pytest.raises(RecordExistsError):
        reg.save_dataset({"name": "d"})
    with pytest.raises(RecordNotFoundError):
        reg.get_experiment("none")
    reg.save_forecast({"experiment_name": "e", "model": "EWMA"})
    reg.save_forecast({"experiment_name": "e", "model": "XGBoost"})
    with pytest.raises(AmbiguousRecordError):
        reg.get_forecast("e")
    assert reg.get_forecast("e", "EWMA")["model"] == "EWMA"


def test_market_client_retries_and_bisects(spark):
    calls = []

    def get(url):
        calls.append(url)
        if len(calls) == 1:
            return 503, "busy"
        if len(calls) == 2:
            return 200, '{"values": [{"datetime": "2024-01-02"}, {"datetime": "2024-01-03"}]}'
        return 200, '{"values": [{"datetime": "2024-01-02"}]}'

    client = Client("http://x", get=get, gap=0, sleep=lambda s: None, page_rows=2)
    assert len(list(client.fetch("A", "1day", T0, T0 + dt.timedelta(days=2)))) == 2 and len(calls) == 4
    with pytest.raises(MarketApiError):
        list(Client("http://x", get=lambda u: (401, "no"), gap=0, sleep=lambda s: None).fetch("A", "1day", T0, T0))
    assert normalize_interval(" Daily ") == "1day"
    df = values_to_dataframe(spark, [{"datetime": "2024-01-02 09:30:00", "open": "1", "high": "2", "low": "1", "close": "1.5", "volume": "x"}] * 2, "aapl")
    assert [(r.asset_id, r.close, r.volume) for r in df.collect()] == [("AAPL", 1.5, None)]
