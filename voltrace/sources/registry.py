"""A registry of datasets, experiments, forecasts, risk results, portfolio results and reports, in the shared store.

Each table is a log of commits: files numbered from 1, a record each, as a line
of JSON (nested values keep their JSON text). A writer reads the log, checks
that its key is free, and creates the next number if nobody else has; whoever
loses that race reads what was committed meanwhile and checks again. So of two
writers of one key exactly one wins, and a version number is a snapshot.
"""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrace.runtime import make_folder, names_in, write_text

#: Table: key columns, and the other columns.
TABLES = {
    "datasets": (("name",), ("source", "assets", "start_date", "end_date", "frequency", "fingerprint", "path", "metadata")),
    "experiments": (("name",), ("description", "models", "metrics", "risk_measures", "parameters", "metadata", "status")),
    "forecasts": (("experiment_name", "model"), ("status", "points", "metadata")),
    "risk_results": (("experiment_name", "model"), ("status", "points", "metadata")),
    "portfolio_results": (("experiment_name", "strategy"), ("status", "positions", "metrics", "metadata")),
    "reports": (("experiment_name", "report_type"), ("status", "sections", "metadata")),
}


class RegistryError(Exception):
    """Base of the registry's errors."""


class RecordExistsError(RegistryError):
    """The key is taken."""


class RecordNotFoundError(RegistryError):
    """No record has the key."""


class AmbiguousRecordError(RegistryError):
    """Several records match a partial key."""


class Registry:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _schema(self, table: str) -> str:
        keys, others = TABLES[table]
        return ", ".join(f"{c} string" for c in (*keys, *others)) + ", created_at timestamp"

    def initialize(self) -> None:
        """Creates the folders of tables that aren't there."""
        for table in TABLES:
            make_folder(self.spark, f"{self.path}/{table}")

    def version(self, table: str) -> int:
        """The number of the last commit, 0 if there is none."""
        return max((int(n[:-5]) for n in names_in(self.spark, f"{self.path}/{table}") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def frame(self, table: str, version: int | None = None) -> DataFrame:
        """The records, or those up to a version."""
        rows = self.spark.read.schema(self._schema(table)).json(f"{self.path}/{table}")
        return rows if version is None else rows.filter(F.col("_metadata.file_name") <= f"{version:020d}.json")

    def _key(self, table: str, key, version: int | None = None) -> DataFrame:
        names = TABLES[table][0]
        df = self.frame(table, version)
        for name, value in zip(names, key, strict=False):
            df = df.filter(F.col(name) == value)
        return df

    def save(self, table: str, record: dict) -> dict:
        keys, others = TABLES[table]
        missing = [k for k in keys if not record.get(k)]
        if missing or set(record) - {*keys, *others, "created_at"}:
            raise RegistryError(f"missing {missing} or unknown fields in {sorted(record)}")
        key = [str(record[k]) for k in keys]
        values = {c: record.get(c) for c in others}
        row = dict(zip(keys, key, strict=True)) | {c: v if v is None or isinstance(v, str) else json.dumps(v, sort_keys=True, default=str) for c, v in values.items()}
        made = record.get("created_at") or datetime.datetime.now(datetime.UTC)
        row["created_at"] = made.isoformat() if isinstance(made, datetime.datetime) else str(made)
        while True:
            seen = self.version(table)
            if not self._key(table, key, seen).isEmpty():
                raise RecordExistsError(f"{table} has {key}")
            if write_text(self.spark, f"{self.path}/{table}/{seen + 1:020d}.json", json.dumps(row) + "\n", new=True):
                return record

    def get(self, table: str, *key: str) -> dict:
        """The record of a whole key, or of a partial one that only one record has."""
        rows = self._key(table, key).limit(2).collect()
        if not rows:
            raise RecordNotFoundError(f"{table} has no {key}")
        if len(rows) > 1:
            raise AmbiguousRecordError(f"several records of {table} match {key}")
        return {k: self._decoded(v) for k, v in rows[0].asDict().items()}

    @staticmethod
    def _decoded(value):
        if isinstance(value, str) and value[:1] in "[{":
            try:
                return json.loads(value)
            except ValueError:
                return value
        return value

    def list(self, table: str, experiment_name: str | None = None) -> DataFrame:
        df = self.frame(table)
        if experiment_name is not None:
            df = df.filter(F.col("experiment_name") == experiment_name)
        return df.orderBy("created_at", *TABLES[table][0])

    # Named forms.
    def save_dataset(self, record): return self.save("datasets", record)  # noqa: E704
    def get_dataset(self, name): return self.get("datasets", name)  # noqa: E704
    def list_datasets(self): return self.list("datasets")  # noqa: E704
    def save_experiment(self, record): return self.save("experiments", record)  # noqa: E704
    def get_experiment(self, name): return self.get("experiments", name)  # noqa: E704
    def list_experiments(self): return self.list("experiments")  # noqa: E704
    def save_forecast(self, record): return self.save("forecasts", record)  # noqa: E704
    def get_forecast(self, name, *model): return self.get("forecasts", name, *model)  # noqa: E704
    def list_forecasts(self, name=None): return self.list("forecasts", name)  # noqa: E704
    def save_risk(self, record): return self.save("risk_results", record)  # noqa: E704
    def get_risk(self, name, *model): return self.get("risk_results", name, *model)  # noqa: E704
    def list_risks(self, name=None): return self.list("risk_results", name)  # noqa: E704
    def save_portfolio(self, record): return self.save("portfolio_results", record)  # noqa: E704
    def get_portfolio(self, name, *strategy): return self.get("portfolio_results", name, *strategy)  # noqa: E704
    def list_portfolios(self, name=None): return self.list("portfolio_results", name)  # noqa: E704
    def save_report(self, record): return self.save("reports", record)  # noqa: E704
    def get_report(self, name, *kind): return self.get("reports", name, *kind)  # noqa: E704
    def list_reports(self, name=None): return self.list("reports", name)  # noqa: E704
