"""Experiments: configuration, isolated runs, and the service's operations as functions over the registry.

Everything here is driver-side control; the work is in the DataFrames that it composes.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrace.operators import evaluation, risk, walkforward
from voltrace.operators.kernels import boost, hmm
from voltrace.operators.portfolio import calculate_performance
from voltrace.operators.volatility import prepare_research_dataset
from voltrace.sources.files import load_raw_dataset, load_text, save_experiment_artifacts, save_text
from voltrace.sources.registry import RecordNotFoundError, Registry, RegistryError

#: Names that a configuration may use.
VOCABULARY = {
    "models": ("EWMA", "GJR-GARCH", "XGBoost", "HMM", "Regime-XGBoost"),
    "metrics": ("MAE", "RMSE", "QLIKE"),
    "risk_measures": ("VaR95", "VaR99", "ES95", "ES99"),
}
DEFAULT_FEATURES = ("return", "realized_volatility", "open", "high", "low", "close", "volume")


class ExperimentConfigurationError(ValueError):
    """A configuration breaks the rules."""


@dataclass(frozen=True)
class ExperimentConfig:
    name: str
    description: str = ""
    models: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    risk_measures: tuple[str, ...] = ()
    parameters: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)


@dataclass(frozen=True)
class ExperimentConfiguration:
    experiments: tuple[ExperimentConfig, ...]

    @property
    def experiment_count(self) -> int:
        return len(self.experiments)

    def get(self, name: str) -> ExperimentConfig:
        for e in self.experiments:
            if e.name == name:
                return e
        raise ExperimentConfigurationError(f"no experiment {name}")


def parse_experiment_config(raw: dict) -> ExperimentConfiguration:
    if not isinstance(raw, dict) or not isinstance(raw.get("experiments"), list):
        raise ExperimentConfigurationError("a list of experiments is needed")
    made = []
    for x in raw["experiments"]:
        if not isinstance(x, dict) or set(x) - set(ExperimentConfig.__dataclass_fields__):
            raise ExperimentConfigurationError(f"unknown fields in {x}")
        lists = {k: tuple(str(v).strip() for v in x.get(k) or ()) for k in VOCABULARY}
        made.append(ExperimentConfig(str(x.get("name") or "").strip(), str(x.get("description") or ""), **lists, parameters=dict(x.get("parameters") or {}), metadata=dict(x.get("metadata") or {})))
    out = ExperimentConfiguration(tuple(made))
    validate_experiment_config(out)
    return out


def validate_experiment_config(configuration: ExperimentConfiguration) -> None:
    names = list_experiment_names(configuration)
    if not names or any(not n for n in names) or len(set(names)) != len(names):
        raise ExperimentConfigurationError("experiments need distinct names")
    for e in configuration.experiments:
        if not e.models:
            raise ExperimentConfigurationError(f"{e.name} has no models")
        for kind, allowed in VOCABULARY.items():
            got = getattr(e, kind)
            if len(set(got)) != len(got) or set(got) - set(allowed):
                raise ExperimentConfigurationError(f"{e.name}: {kind} {got}")


def list_experiment_names(configuration: ExperimentConfiguration) -> list[str]:
    return [e.name for e in configuration.experiments]


def load_experiment_config(path: str) -> ExperimentConfiguration:
    import yaml

    return parse_experiment_config(yaml.safe_load(load_text(path)))


def save_experiment_config(configuration: ExperimentConfiguration, path: str) -> str:
    import yaml

    validate_experiment_config(configuration)
    plain = [{k: list(v) if isinstance(v, tuple) else v for k, v in asdict(e).items()} for e in configuration.experiments]
    return save_text(yaml.safe_dump({"experiments": plain}, sort_keys=False), path)


# Runs ---------------------------------------------------------------------------


@dataclass(frozen=True)
class ExperimentRunResult:
    name: str
    status: str
    result: object = None
    error: str | None = None


@dataclass(frozen=True)
class ExperimentRunSummary:
    results: tuple[ExperimentRunResult, ...]

    @property
    def succeeded(self) -> int:
        return sum(r.status == "succeeded" for r in self.results)

    @property
    def failed(self) -> int:
        return len(self.results) - self.succeeded

    @property
    def all_successful(self) -> bool:
        return not self.failed


class ExperimentRunner:
    """Handlers by experiment name; one that raises is a failed result and stops no other."""

    def __init__(self, configuration: ExperimentConfiguration, handlers: dict[str, Callable[[ExperimentConfig], object]]) -> None:
        self.configuration, self.handlers = configuration, handlers

    def run(self) -> ExperimentRunSummary:
        out = []
        for e in self.configuration.experiments:
            handler = self.handlers.get(e.name)
            if handler is None:
                out.append(ExperimentRunResult(e.name, "failed", error="no handler"))
                continue
            try:
                out.append(ExperimentRunResult(e.name, "succeeded", handler(e)))
            except Exception as error:  # any failure stays with its experiment
                out.append(ExperimentRunResult(e.name, "failed", error="".join(traceback.format_exception_only(error)).strip()))
        return ExperimentRunSummary(tuple(out))


def run_experiments(configuration: ExperimentConfiguration, *, handlers) -> ExperimentRunSummary:
    return ExperimentRunner(configuration, handlers).run()


def research_folds(parameters: dict) -> dict:
    return {"train_size": int(parameters.get("train_size", 120)), "test_size": int(parameters.get("test_size", 1)), "step_size": int(parameters.get("step_size", 1)), "expanding": bool(parameters.get("expanding", False))}


def model_parameters(parameters: dict) -> dict:
    h, b = parameters.get("hmm") or {}, parameters.get("boost") or {}
    return {"decay": float(parameters.get("ewma_decay", 0.94)), "hmm_config": hmm.Config(**({"n_components": 3} | h)), "boost_config": boost.Config(**b)}


def feature_columns(parameters: dict) -> list[str]:
    return list(parameters.get("feature_columns") or DEFAULT_FEATURES)


def execute_research(df: DataFrame, experiment: ExperimentConfig) -> DataFrame:
    """Predictions of all models of an experiment; HMM is no forecast of its own and is left out."""
    p, out = experiment.parameters, None
    for model in experiment.models:
        if model == "HMM":
            continue
        options = model_parameters(p) | research_folds(p)
        if "XGBoost" in model:
            options["feature_columns"] = feature_columns(p)
        part = walkforward.run_model(df, model, **options)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ExperimentConfigurationError(f"{experiment.name} has no forecasting model")
    return out


class Service:
    """What the HTTP routes do, without HTTP."""

    def __init__(self, spark: SparkSession, registry: Registry, artifacts: str) -> None:
        self.spark, self.registry, self.artifacts = spark, registry, artifacts

    def health_check(self) -> dict:
        return {"status": "ok"}

    def create_dataset(self, record: dict) -> dict:
        start, end = record.get("start_date"), record.get("end_date")
        if start and end and str(start) > str(end):
            raise RegistryError("start_date is after end_date")
        return self.registry.save_dataset(record)

    def validate_dataset(self, request: dict) -> dict:
        """Whether a request agrees with the registered record, field by field."""
        found = self.registry.get_dataset(request["name"])
        differ = sorted(k for k, v in request.items() if v is not None and found.get(k) != v)
        return {"name": request["name"], "valid": not differ, "differences": differ}

    def list_datasets(self) -> DataFrame:
        return self.registry.list_datasets()

    def create_experiment(self, request: dict) -> dict:
        parse_experiment_config({"experiments": [request]})
        return self.registry.save_experiment({**request, "status": "registered"})

    def list_experiments(self) -> DataFrame:
        return self.registry.list_experiments()

    def get_experiment(self, name: str) -> dict:
        return self.registry.get_experiment(name)

    def resolve_dataset(self, parameters: dict) -> dict:
        """By name, by an asset, or the only one there is."""
        if name := parameters.get("dataset"):
            return self.registry.get_dataset(name)
        rows = self.registry.frame("datasets")
        if assets := parameters.get("assets"):
            rows = rows.filter(F.arrays_overlap(F.from_json("assets", "array<string>"), F.array(*map(F.lit, assets))))
        names = [r.name for r in rows.select("name").limit(2).collect()]
        if len(names) != 1:
            raise RecordNotFoundError("name one dataset")
        return self.registry.get_dataset(names[0])

    def run_experiment(self, name: str) -> ExperimentRunResult:
        return self.run_experiments([name]).results[0]

    def run_experiments(self, names: list[str]) -> ExperimentRunSummary:
        """Runs registered experiments in this order; one that fails stops no other."""
        records = [self.registry.get_experiment(name) for name in names]
        config = parse_experiment_config({"experiments": [{k: r[k] for k in ExperimentConfig.__dataclass_fields__ if r.get(k) is not None} for r in records]})

        def handler(e: ExperimentConfig) -> dict:
            data = self.resolve_dataset(e.parameters)
            bars = load_raw_dataset(self.spark, data["path"], assets=e.parameters.get("assets"), start=e.parameters.get("start"), end=e.parameters.get("end"))
            predictions = execute_research(prepare_research_dataset(bars, lag_days=int(e.parameters.get("lag_days", 0))), e)
            return save_experiment_artifacts(e.name, {"experiment": asdict(e), "dataset": data["name"]}, predictions, output_directory=self.artifacts)

        return run_experiments(config, handlers=dict.fromkeys(names, handler))

    def _predictions(self, name: str) -> DataFrame:
        from voltrace.sources.files import load_experiment_results

        return load_experiment_results(self.spark, name, output_directory=self.artifacts)

    def create_forecast(self, experiment_name: str, model: str) -> dict:
        return self.registry.save_forecast({"experiment_name": experiment_name, "model": model, "status": "accepted"})

    def get_forecast(self, experiment_name: str, *model: str) -> dict:
        return self.registry.get_forecast(experiment_name, *model)

    def evaluate_forecast(self, experiment_name: str, model: str) -> DataFrame:
        return self.compare_forecasts(experiment_name).filter(F.col("model") == model)

    def compare_forecasts(self, experiment_name: str) -> DataFrame:
        return evaluation.compare_forecasts(self._predictions(experiment_name), actual_column="actual_volatility", forecast_column="prediction")

    def create_risk_analysis(self, experiment_name: str, model: str) -> dict:
        return self.registry.save_risk({"experiment_name": experiment_name, "model": model, "status": "accepted"})

    def get_risk_analysis(self, experiment_name: str, *model: str) -> dict:
        return self.registry.get_risk(experiment_name, *model)

    def backtest_risk(self, table: DataFrame, confidence_level: float, *, by=("model",)) -> DataFrame:
        """Kupiec and Christoffersen of (by..., timestamp, actual_return, var_loss)."""
        k = risk.kupiec_unconditional_coverage(table, confidence_level, by=by)
        c = risk.christoffersen_test(table, confidence_level, by=by).select(*by, "lr_ind", "lr_cc", "p_ind", "p_cc", "reject_ind", "reject_cc")
        return k.join(c, list(by))

    compare_risk = backtest_risk

    def create_portfolio_analysis(self, experiment_name: str, strategy: str) -> dict:
        return self.registry.save_portfolio({"experiment_name": experiment_name, "strategy": strategy, "status": "accepted"})

    def get_portfolio_analysis(self, experiment_name: str, *strategy: str) -> dict:
        return self.registry.get_portfolio(experiment_name, *strategy)

    def compare_portfolios(self, returns: DataFrame, *, by=("strategy",)) -> DataFrame:
        return calculate_performance(returns, by=by)

    def create_report(self, experiment_name: str, report_type: str) -> dict:
        return self.registry.save_report({"experiment_name": experiment_name, "report_type": report_type, "status": "accepted"})

    def get_report(self, experiment_name: str, *report_type: str) -> dict:
        return self.registry.get_report(experiment_name, *report_type)

    def run_report(self, experiment_name: str) -> dict[str, DataFrame]:
        predictions = self._predictions(experiment_name)
        return {"metrics": self.compare_forecasts(experiment_name), "coverage": predictions.groupBy("model").agg(F.count(F.lit(1)).alias("predictions"), F.count_distinct("fold_id").alias("folds"))}
