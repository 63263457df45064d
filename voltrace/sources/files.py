"""CSV, Parquet and JSON sources and sinks of the contract."""

from __future__ import annotations

import datetime
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrace.runtime import read_text, write_text
from voltrace.sources.contract import CanonicalDataset, ContractError, assert_canonical_schema, build_canonical_dataset, canonical_columns, raise_if_invalid, require_columns, to_canonical, validate_ohlcv


def _loaded(df: DataFrame, validate: bool) -> DataFrame:
    require_columns(df)
    return to_canonical(df, validate=validate)


def load_csv(spark: SparkSession, path: str, *, validate: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """Read as text and cast: no inference pass."""
    return _loaded(spark.read.csv(path, header=True, encoding=encoding), validate)


def load_csv_raw(spark: SparkSession, path: str, *, encoding: str = "UTF-8") -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True, encoding=encoding)


def load_csv_chunks(spark: SparkSession, path: str, *, chunksize: int = 100_000, encoding: str = "UTF-8"):
    """Row chunks for a driver-side consumer; distributed code reads load_csv_raw, whose partitions are the chunks."""
    chunk = []
    for row in load_csv_raw(spark, path, encoding=encoding).toLocalIterator():
        chunk.append(row)
        if len(chunk) == chunksize:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def _suffix(path: str, *suffixes: str) -> str:
    if not path.lower().endswith(suffixes):
        raise ContractError(f"{path} must end in {' or '.join(suffixes)}")
    return path


def save_csv(df: DataFrame, path: str, *, validate: bool = True) -> str:
    to_canonical(df, validate=validate).write.mode("overwrite").csv(_suffix(path, ".csv"), header=True)
    return path


def load_parquet(spark: SparkSession, path: str, *, validate: bool = True) -> DataFrame:
    return _loaded(spark.read.parquet(path), validate)


def load_parquet_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_parquet(df: DataFrame, path: str, *, validate: bool = True, compression: str = "snappy", partition_by_asset: bool = False) -> str:
    """partition_by_asset gives readers partition pruning by asset."""
    out = to_canonical(df, validate=validate)
    assert_canonical_schema(out)
    writer = out.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy("asset_id") if partition_by_asset else writer).parquet(_suffix(path, ".parquet", ".pq"))
    return path


def save_canonical_parquet(df: DataFrame, path: str, *, validate: bool = False, compression: str = "snappy") -> str:
    assert_canonical_schema(df)
    if validate:
        raise_if_invalid(validate_ohlcv(df))
    df.write.mode("overwrite").option("compression", compression).parquet(_suffix(path, ".parquet", ".pq"))
    return path


def load_canonical_parquet(spark: SparkSession, path: str, *, validate: bool = True) -> DataFrame:
    return to_canonical(spark.read.parquet(path), validate=validate)


def load_and_verify_parquet(spark: SparkSession, path: str, *, validate: bool = True) -> DataFrame:
    out = load_parquet(spark, path, validate=validate)
    assert_canonical_schema(out)
    return out


def canonicalize_and_save(df: DataFrame, path: str) -> CanonicalDataset:
    made = build_canonical_dataset(df)
    save_canonical_parquet(made.frame, path)
    return made


# Artifacts ----------------------------------------------------------------------


#: Rows of a table inside a JSON artifact; more are refused, never cut.
JSON_ROWS = 10_000


def _encoded(value):
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    if isinstance(value, DataFrame):
        rows = value.limit(JSON_ROWS + 1).collect()
        if len(rows) > JSON_ROWS:
            raise ContractError(f"a table of more than {JSON_ROWS} rows belongs in a DataFrame artifact")
        return [r.asDict(recursive=True) for r in rows]
    if hasattr(value, "item"):
        return value.item()
    raise TypeError(f"no JSON for {type(value)}")


def save_text(text: str, path: str) -> str:
    """Into whatever store the path names; without a session, a local file."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        write_text(spark, path, text)
    else:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return path


def load_text(path: str) -> str:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        return read_text(spark, path)
    with open(path, encoding="utf-8") as f:
        return f.read()


def save_json_artifact(data: dict, path: str) -> str:
    """Into whatever store the path names, like the tables beside it."""
    return save_text(json.dumps(data, sort_keys=True, indent=2, default=_encoded), path)


def load_json_artifact(path: str) -> dict:
    data = json.loads(load_text(path))
    if not isinstance(data, dict):
        raise ContractError(f"{path} holds no JSON object")
    return data


def save_dataframe_artifact(df: DataFrame, path: str) -> str:
    if df.isEmpty():
        raise ContractError("an artifact must have rows")
    df.write.mode("overwrite").parquet(path)
    return path


def load_dataframe_artifact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _experiment_dir(name: str, directory: str) -> str:
    safe = "".join(c if c.isalnum() or c in "-_." else "_" for c in name.strip())
    if not safe.strip("._"):
        raise ContractError("an experiment needs a name")
    return os.path.join(directory, safe)


def save_experiment_artifacts(name: str, metadata: dict, results: DataFrame | None = None, *, output_directory: str = "experiments") -> dict[str, str]:
    at = _experiment_dir(name, output_directory)
    paths = {"metadata": save_json_artifact(metadata, os.path.join(at, "metadata.json"))}
    if results is not None:
        paths["results"] = save_dataframe_artifact(results, os.path.join(at, "results.parquet"))
    return paths


def load_experiment_metadata(name: str, *, output_directory: str = "experiments") -> dict:
    return load_json_artifact(os.path.join(_experiment_dir(name, output_directory), "metadata.json"))


def load_experiment_results(spark: SparkSession, name: str, *, output_directory: str = "experiments") -> DataFrame:
    return load_dataframe_artifact(spark, os.path.join(_experiment_dir(name, output_directory), "results.parquet"))


def load_raw_dataset(spark: SparkSession, path: str, *, fmt: str | None = None, assets=None, start=None, end=None, ordinal: str | None = None) -> DataFrame:
    """Source dispatch by format, then null rows, assets and time range out, and the last row of each key.

    Filters stay declarative, so they reach a Parquet scan. "Last" is by ordinal, a column that orders
    the rows; without one, by the price columns, as rows have no order.
    """
    fmt = fmt or os.path.splitext(path)[1].lstrip(".").lower()
    if fmt == "csv":
        df = spark.read.csv(path, header=True)
    elif fmt in ("parquet", "pq"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.format(fmt).load(path)
    extra = [F.col(ordinal).alias("__ordinal")] if ordinal else []
    typed = canonical_columns(df).schema.fieldNames()
    base = require_columns(df)
    if assets:
        base = base.filter(F.upper(F.trim("asset_id")).isin(*[a.strip().upper() for a in assets]))
    rows = base.select(*(F.expr(f"try_cast(`{c}` AS {'timestamp' if c == 'timestamp' else 'string' if c == 'asset_id' else 'double'})").alias(c) for c in typed), *extra)
    rows = rows.withColumn("asset_id", F.upper(F.trim("asset_id"))).na.drop(subset=typed)
    if start is not None:
        rows = rows.filter(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.filter(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    order = F.col("__ordinal") if ordinal else F.struct("open", "high", "low", "close", "volume")
    best = rows.groupBy("timestamp", "asset_id").agg(F.max_by(F.struct("open", "high", "low", "close", "volume"), order).alias("row"))
    return best.select("timestamp", "asset_id", "row.*")
