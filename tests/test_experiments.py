import datetime as dt

import numpy as np
import pytest

from voltrace.plans import experiments
from voltrace.sources.registry import Registry

CONFIG = {"experiments": [
    {"name": "one", "models": ["EWMA", "XGBoost", "HMM"], "metrics": ["MAE"], "parameters": {"train_size": 20, "test_size": 1, "step_size": 10, "boost": {"n_estimators": 3}, "feature_columns": ["return"]}},
    {"name": "two", "models": ["EWMA"]}]}


def test_config_round_trip(tmp_path):
    made = experiments.parse_experiment_config(CONFIG)
    assert made.experiment_count == 2 and made.get("one").models == ("EWMA", "XGBoost", "HMM")
    assert experiments.load_experiment_config(experiments.save_experiment_config(made, f"{tmp_path}/c.yaml")) == made
    for bad in ({"experiments": [{"name": "x", "models": ["NOPE"]}]}, {"experiments": [{"name": "x", "models": []}]}, {"experiments": [CONFIG["experiments"][1]] * 2}, {}):
        with pytest.raises(experiments.ExperimentConfigurationError):
            experiments.parse_experiment_config(bad)


def test_failures_stay_with_their_experiment():
    made = experiments.parse_experiment_config(CONFIG)
    got = experiments.run_experiments(made, handlers={"one": lambda e: 1 / 0, "two": lambda e: "done"})
    assert (got.succeeded, got.failed, got.all_successful) == (1, 1, False) and "ZeroDivisionError" in got.results[0].error


def test_service_runs_an_experiment(spark, tmp_path):
    rng = np.random.default_rng(0)
    day, price, rows = dt.datetime(2024, 1, 1), 100.0, []
    for d in range(14):
        for h in range(4):
            price *= float(np.exp(rng.normal(0, 0.01)))
            rows.append((day + dt.timedelta(days=d, hours=9 + h), "A", price, price * 1.01, price * 0.99, price, 10.0))
    path = f"{tmp_path}/bars.parquet"
    spark.createDataFrame(rows, "timestamp timestamp, asset_id string, open double, high double, low double, close double, volume double").write.parquet(path)
    registry = Registry(spark, f"{tmp_path}/reg")
    registry.initialize()
    service = experiments.Service(spark, registry, f"{tmp_path}/out")
    service.create_dataset({"name": "bars", "path": path, "assets": ["A"]})
    assert service.validate_dataset({"name": "bars", "path": path})["valid"] and not service.validate_dataset({"name": "bars", "path": "x"})["valid"]
    service.create_experiment(CONFIG["experiments"][0])
    done = service.run_experiment("one")
    assert done.status == "succeeded", done.error
    got = {r.model: r.observations for r in service.compare_forecasts("one").collect()}
    assert set(got) == {"EWMA", "XGBoost"} and min(got.values()) > 0
    assert service.evaluate_forecast("one", "EWMA").count() == 1
    assert service.run_report("one")["coverage"].count() == 2
