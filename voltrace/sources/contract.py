"""The OHLCV contract: canonical columns, validation report, metadata and fingerprints."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ("timestamp", "asset_id")
PRICES = ("open", "high", "low", "close")
CANONICAL = T.StructType([
    T.StructField("timestamp", T.TimestampType()), T.StructField("asset_id", T.StringType()),
    *(T.StructField(c, T.DoubleType()) for c in (*PRICES, "volume")),
])


class ContractError(ValueError):
    """A table breaks the contract."""


def require_columns(df: DataFrame, columns=CANONICAL.fieldNames()) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


validate_required_columns = require_columns


def _number(name: str) -> Column:
    x = F.expr(f"try_cast(`{name}` AS double)")
    return F.when(~F.isnan(x), x)


def canonical_columns(df: DataFrame) -> DataFrame:
    """The seven canonical columns, cast; what can't be cast is null. Narrow and lazy: no check runs."""
    require_columns(df)
    return df.select(
        F.expr("try_cast(`timestamp` AS timestamp)").alias("timestamp"),
        F.upper(F.trim(F.col("asset_id").cast("string"))).alias("asset_id"),
        *(_number(c).alias(c) for c in (*PRICES, "volume")))


def to_canonical(df: DataFrame, *, validate: bool = True) -> DataFrame:
    """Canonical columns; with validate, one aggregate rejects broken keys and values."""
    out = canonical_columns(df)
    if validate:
        raise_if_invalid(validate_ohlcv(out))
    return out


def duplicate_keys(df: DataFrame) -> DataFrame:
    """One row: n, the rows whose key occurs more than once (all copies count)."""
    return df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n"))


validate_no_duplicates = duplicate_keys


def _outside() -> Column:
    whole = F.lit(True)
    for c in PRICES:
        whole &= F.col(c).isNotNull()
    bad = (F.col("high") < F.col("low")) | ~F.col("open").between(F.col("low"), F.col("high")) | ~F.col("close").between(F.col("low"), F.col("high"))
    return whole & bad


#: Rules of one row: name to (severity, condition of a violation).
def row_rules() -> dict[str, tuple[str, Column]]:
    rules = {f"null_{c}": ("error", F.col(c).isNull()) for c in CANONICAL.fieldNames()}
    rules["blank_asset_id"] = ("error", F.length("asset_id") == 0)
    rules |= {f"infinite_{c}": ("error", F.abs(c) == float("inf")) for c in (*PRICES, "volume")}
    rules |= {f"non_positive_{c}": ("error", F.col(c) <= 0) for c in PRICES}
    rules["negative_volume"] = ("error", F.col("volume") < 0)
    rules["ohlc_relationship"] = ("error", _outside())
    rules["zero_volume"] = ("warning", F.col("volume") == 0)
    return rules


def validate_ohlcv(df: DataFrame) -> DataFrame:
    """(rule, severity, n): violations by rule, from one pass for rows and one keyed aggregate for duplicates."""
    require_columns(df)
    rules = row_rules()
    counts = df.agg(
        *(F.count_if(F.coalesce(cond, F.lit(False))).alias(name) for name, (_, cond) in rules.items()),
        F.count(F.lit(1)).alias("rows"), F.count_distinct("asset_id").alias("assets"))
    severity = {name: s for name, (s, _) in rules.items()}
    entries = [F.struct(F.lit(name).alias("rule"), F.lit(severity[name]).alias("severity"), F.col(name).alias("n")) for name in rules]
    entries += [
        F.struct(F.lit("empty").alias("rule"), F.lit("error").alias("severity"), F.when(F.col("rows") == 0, 1).otherwise(0).cast("long").alias("n")),
        F.struct(F.lit("single_asset").alias("rule"), F.lit("warning").alias("severity"), F.when(F.col("assets") == 1, 1).otherwise(0).cast("long").alias("n")),
    ]
    rows = counts.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    copies = duplicate_keys(df).select(F.lit("duplicate_key").alias("rule"), F.lit("error").alias("severity"), F.col("n").cast("long").alias("n"))
    return rows.unionByName(copies)


def raise_if_invalid(report: DataFrame) -> None:
    bad = report.filter("severity = 'error' and n > 0").collect()  # at most one row for each rule
    if bad:
        raise ContractError("; ".join(f"{r.rule}: {r.n}" for r in sorted(bad)))


def validate_positive_prices(df: DataFrame) -> DataFrame:
    return df.agg(*(F.count_if(F.col(c) <= 0).alias(c) for c in PRICES))


def validate_non_negative_volume(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("volume") < 0).alias("n"))


def validate_ohlc_relationships(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.coalesce(_outside(), F.lit(False))).alias("n"))


def validate_chronological_order(df: DataFrame, ordinal: str) -> DataFrame:
    """(asset_id, n): steps back in time in the order of an explicit ordinal column, as Spark rows have no order of their own."""
    back = F.col("timestamp") < F.lag("timestamp").over(Window.partitionBy("asset_id").orderBy(ordinal))
    return df.select("asset_id", back.alias("back")).groupBy("asset_id").agg(F.count_if("back").alias("n"))


def dataset_metadata(df: DataFrame) -> DataFrame:
    """One row: sorted asset ids, row_count, start and end."""
    return df.agg(F.sort_array(F.collect_set("asset_id")).alias("asset_ids"), F.count(F.lit(1)).alias("row_count"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))


get_dataset_metadata = dataset_metadata


@dataclass(frozen=True)
class CanonicalDataset:
    frame: DataFrame
    asset_ids: tuple[str, ...]
    row_count: int
    start: object
    end: object


def build_canonical_dataset(df: DataFrame, *, validate: bool = True) -> CanonicalDataset:
    frame = to_canonical(df, validate=validate)
    m = dataset_metadata(frame).first()
    return CanonicalDataset(frame, tuple(m.asset_ids), m.row_count, m.start, m.end)


def assert_canonical_schema(df: DataFrame) -> None:
    found = [(f.name, f.dataType) for f in df.schema.fields]
    if found != [(f.name, f.dataType) for f in CANONICAL.fields]:
        raise ContractError(f"not the canonical schema: {df.schema.simpleString()}")


# Fingerprints -------------------------------------------------------------------


def _exact_text(x: Column) -> Column:
    """A double as text, without loss: sign, 53-bit integer and power of two (empty if null; 0, nan, inf and -inf by name)."""
    size = F.abs(x)
    power = F.floor(F.log2(F.when(size > 0, size))) - 52

    def scaled(k: Column) -> Column:  # in two steps, as one power of two may be out of range
        half = F.floor(-k / 2)
        return size * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), -k - half)

    # A rounded logarithm may be one off.
    power = F.when(scaled(power) >= 2.0**53, power + 1).when(scaled(power) < 2.0**52, power - 1).otherwise(power)
    exact = F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), scaled(power).cast("long").cast("string"), F.lit("p"), power.cast("long").cast("string"))
    text = F.when(F.isnan(x), "nan").when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).when(x == 0, "0").otherwise(exact)
    return F.coalesce(text, F.lit(""))


def _line() -> Column:
    """A row in its canonical encoding, fields joined by commas: UTC time to the microsecond, id, then the numbers, each without loss."""
    stamp = F.coalesce(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(""))
    return F.concat_ws(",", stamp, F.coalesce("asset_id", F.lit("")), *(_exact_text(F.col(c).cast("double")) for c in (*PRICES, "volume")))


@dataclass(frozen=True)
class DatasetFingerprint:
    sha256: str
    row_count: int
    asset_count: int
    start: str
    end: str

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True, separators=(",", ":"))


def fingerprint_row(df: DataFrame) -> DataFrame:
    """One row (sha256, row_count, asset_count, start, end), whatever the order or partitions of df.

    A multiset hash that others can recompute: the MD5s of the rows' canonical encodings, as 128-bit numbers, are added modulo 2^128, which is an aggregate
    without a sort. sha256 is that of the sum as 32 hex digits, a colon and the number of rows.
    """
    word, wide = 1 << 32, "decimal(38,0)"
    sums = [F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")).cast(wide).alias(f"s{k}") for k in range(4)]
    text = "yyyy-MM-dd'T'HH:mm:ss"
    out = df.select("timestamp", "asset_id", F.md5(_line()).alias("h")).agg(
        *sums, F.count(F.lit(1)).alias("row_count"), F.count_distinct("asset_id").alias("asset_count"), F.date_format(F.min("timestamp"), text).alias("start"), F.date_format(F.max("timestamp"), text).alias("end"))
    for k in (3, 2, 1, 0):  # carries go from the last word to the first
        total = F.coalesce(F.col(f"s{k}"), F.lit(0).cast(wide)) + (F.col(f"c{k + 1}") if k < 3 else F.lit(0).cast(wide))
        out = out.withColumn(f"t{k}", total.cast(wide)).withColumn(f"c{k}", F.expr(f"CAST(t{k} DIV {word} AS {wide})"))
    digits = F.concat(*(F.lpad(F.lower(F.hex((F.col(f"t{k}") % word).cast("long"))), 8, "0") for k in range(4)))
    return out.select(F.sha2(F.concat_ws(":", digits, F.col("row_count").cast("string")), 256).alias("sha256"), "row_count", "asset_count", "start", "end")


def fingerprint_dataframe(df: DataFrame, *, validate: bool = True) -> DatasetFingerprint:
    return DatasetFingerprint(**fingerprint_row(to_canonical(df, validate=validate)).first().asDict())


def fingerprint_stream(df: DataFrame) -> str:
    """SHA-256 of all canonical lines in key order, streamed to the driver a partition at a time. For small tables."""
    h = hashlib.sha256()
    for row in df.orderBy("asset_id", "timestamp").select(_line().alias("line")).toLocalIterator(prefetchPartitions=False):
        h.update(row.line.encode() + b"\n")
    return h.hexdigest()


def fingerprint_parquet(spark, path: str, *, validate: bool = True) -> DatasetFingerprint:
    return fingerprint_dataframe(spark.read.parquet(path), validate=validate)


def fingerprint_file(spark, path: str) -> DataFrame:
    """(path, sha256) of the raw bytes of each file under path, hashed by executors."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def verify_fingerprint(df: DataFrame, expected: str, *, validate: bool = True) -> bool:
    return fingerprint_dataframe(df, validate=validate).sha256 == expected.strip().lower()
