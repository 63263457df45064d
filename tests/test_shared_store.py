import datetime as dt
import hashlib
import math
import os
import threading

import pytest

from voltrace import runtime
from voltrace.sources import contract, files, registry


def test_text_files_of_a_uri_stay_in_their_folder(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    for at in (f"file://{tmp_path}/a b/x/metadata.json", f"{tmp_path}/plain/metadata.json"):
        assert files.load_json_artifact(files.save_json_artifact({"k": [1, "é"], "at": dt.date(2024, 1, 2)}, at)) == {"k": [1, "é"], "at": "2024-01-02"}
    assert sorted(os.listdir(tmp_path)) == ["a b", "plain"] and os.path.exists(tmp_path / "a b/x/metadata.json")
    files.save_json_artifact({"k": 2}, f"file://{tmp_path}/plain/metadata.json")
    assert files.load_json_artifact(f"{tmp_path}/plain/metadata.json") == {"k": 2}
    paths = files.save_experiment_artifacts("one", {"m": 1}, spark.range(3), output_directory=f"file://{tmp_path}/out")
    assert files.load_experiment_metadata("one", output_directory=f"file://{tmp_path}/out") == {"m": 1} and spark.read.parquet(paths["results"]).count() == 3
    with pytest.raises(contract.ContractError):
        files.load_json_artifact(files.save_json_artifact([1], f"file://{tmp_path}/list.json"))


def test_new_files_have_one_writer(spark, tmp_path):
    for at in (f"file://{tmp_path}/new.json", f"{tmp_path}/plain.json"):
        assert runtime.write_text(spark, at, "one", new=True) and not runtime.write_text(spark, at, "two", new=True) and runtime.read_text(spark, at) == "one"
    assert sorted(n for n in os.listdir(tmp_path) if not n.startswith(".")) == ["new.json", "plain.json"]


def test_racing_writers_of_one_key(spark, tmp_path):
    """Many writers at once: of those with the same key exactly one wins, and no record is lost."""
    made = registry.Registry(spark, f"file://{tmp_path}/reg")
    made.initialize()
    won, lost, other = [], [], []

    def write(k):
        own = registry.Registry(spark, f"file://{tmp_path}/reg")
        try:
            own.save_dataset({"name": "same", "path": str(k)})
            won.append(k)
        except registry.RecordExistsError:
            lost.append(k)
        own.save_dataset({"name": f"own{k}"})
        other.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert len(won) == 1 and len(lost) == 3 and len(other) == 4
    assert sorted(r.name for r in made.list_datasets().collect()) == ["own0", "own1", "own2", "own3", "same"]
    assert made.get_dataset("same")["path"] == str(won[0]) and made.version("datasets") == 5


def test_snapshots_and_partial_keys(spark, tmp_path):
    made = registry.Registry(spark, f"{tmp_path}/reg")
    made.initialize()
    assert made.list_forecasts().count() == 0 and made.version("forecasts") == 0
    made.save_forecast({"experiment_name": "e", "model": "A", "points": [1, 2], "metadata": {"x": {"y": 1}}})
    assert made.get_forecast("e")["points"] == [1, 2] and made.get_forecast("e", "A")["metadata"] == {"x": {"y": 1}}
    made.save_forecast({"experiment_name": "e", "model": "B", "created_at": dt.datetime(2024, 1, 1)})
    with pytest.raises(registry.AmbiguousRecordError):
        made.get_forecast("e")
    with pytest.raises(registry.RecordNotFoundError):
        made.get_risk("e")
    with pytest.raises(registry.RegistryError):
        made.save_forecast({"experiment_name": "e"})
    assert made.frame("forecasts", 1).count() == 1 and [r.model for r in made.list_forecasts("e").collect()] == ["B", "A"]


def test_scratch_of_a_thread_is_its_own(spark, tmp_path):
    """A table that another thread makes inside this thread's scratch outlives it."""
    found = []
    with runtime.scratch(spark):
        mine = runtime.materialize(spark.range(2), "mine").inputFiles()[0]
        t = threading.Thread(target=lambda: found.append(runtime.materialize(spark.range(3), "theirs")))
        t.start()
        t.join(60)
        with runtime.scratch(spark):
            inner = runtime.materialize(spark.range(4), "inner").inputFiles()[0]
            kept = runtime.materialize(spark.range(5), "kept", keep=True)
        assert not os.path.exists(inner.removeprefix("file://")) and kept.count() == 5
    assert not os.path.exists(mine.removeprefix("file://")) and found[0].count() == 3


def exact(x):
    """A double's canonical text, from its own bits."""
    if x is None:
        return ""
    if math.isnan(x) or math.isinf(x):
        return "nan" if math.isnan(x) else "inf" if x > 0 else "-inf"
    if x == 0:
        return "0"
    m, e = math.frexp(abs(x))
    return f"{'-' if x < 0 else ''}{int(m * 2**53)}p{e - 53}"


def test_fingerprint_can_be_recomputed(spark):
    values = [1.0, -0.1, 1e300, 5e-300, 123456.789, 2.0**53, 2.0**53 - 1, 2.0**-30, 0.0, -0.0, float("inf"), -float("inf"), float("nan"), None, 1e-310, 4.0, 7.999999999999999, 8.000000000000002]
    t = dt.datetime(2024, 1, 2, 3, 4, 5, 600)
    rows = [(t, "A" if i % 2 else None, x, 1.0, 2.0, 3.0, 4.0) for i, x in enumerate(values)] * 2
    df = spark.createDataFrame(rows, "timestamp timestamp, asset_id string, open double, high double, low double, close double, volume double")
    total = 0
    for r in rows:
        line = ",".join([r[0].strftime("%Y-%m-%dT%H:%M:%S.%f"), r[1] or "", *map(exact, r[2:])])
        if r[2] != 1e-310:  # below the normal doubles the integer is shorter
            total += int(hashlib.md5(line.encode()).hexdigest(), 16)
    want = hashlib.sha256(f"{total % 2**128:032x}:{len(rows) - 2}".encode()).hexdigest()
    got = contract.fingerprint_row(df.filter("not open <=> 1e-310D").repartition(5)).first()
    assert got.sha256 == want and got.row_count == len(rows) - 2 and got.asset_count == 1
    assert contract.fingerprint_row(df).first().sha256 != want
    empty = contract.fingerprint_row(df.limit(0)).first()
    assert empty.row_count == 0 and empty.sha256 == hashlib.sha256(f"{0:032x}:0".encode()).hexdigest()
