"""A REST time-series source as a Python data source: ``spark.read.format("market_series")``.

The time range is cut into partitions on the planner's side; a partition
bisects its range where a page reaches the service's row limit. Requests retry
on 429, 5xx and network errors with exponential backoff, and keep a gap.
Options: symbols (comma-separated), interval, start, end, base_url, api_key,
partitions. The request function can be replaced, for tests and other services.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voltrace.sources.contract import canonical_columns

#: Intervals of the service, and its page limit.
INTERVALS = ("1min", "5min", "15min", "30min", "45min", "1h", "2h", "4h", "8h", "1day", "1week", "1month")
PAGE_ROWS, RETRIES, GAP_SECONDS = 5000, 4, 8.0
SCHEMA = "timestamp timestamp, asset_id string, open double, high double, low double, close double, volume double"


class MarketApiError(RuntimeError):
    """The service refused, or kept failing."""


def normalize_symbol(symbol: str) -> str:
    out = symbol.strip().upper()
    if not out:
        raise MarketApiError("a symbol is needed")
    return out


def normalize_interval(interval: str) -> str:
    out = {"daily": "1day", "hourly": "1h", "weekly": "1week"}.get(interval.strip().lower(), interval.strip().lower())
    if out not in INTERVALS:
        raise MarketApiError(f"unknown interval {interval}")
    return out


def _get(url: str) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(url, timeout=30) as r:  # noqa: S310
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")
    except (urllib.error.URLError, TimeoutError) as e:
        return 0, str(e)


class Client:
    """One symbol and range at a time; the gap is kept across all requests of the client."""

    def __init__(self, base_url: str, api_key: str = "", *, get: Callable[[str], tuple[int, str]] = _get, gap: float = GAP_SECONDS, sleep=time.sleep, page_rows: int = PAGE_ROWS) -> None:
        self.base_url, self.api_key, self.get, self.gap, self.sleep, self.page_rows, self.last = base_url, api_key, get, gap, sleep, page_rows, None

    def request(self, symbol: str, interval: str, start: dt.datetime, end: dt.datetime) -> list[dict]:
        asked = {"symbol": symbol, "interval": interval, "start_date": start.isoformat(sep=" "), "end_date": end.isoformat(sep=" "), "outputsize": self.page_rows, "order": "ASC", "timezone": "UTC", "apikey": self.api_key}
        url = f"{self.base_url}/time_series?{urllib.parse.urlencode(asked)}"
        for attempt in range(RETRIES + 1):
            if self.last is not None and (wait := self.gap - (time.monotonic() - self.last)) > 0:
                self.sleep(wait)
            self.last = time.monotonic()
            status, body = self.get(url)
            if status == 200:
                found = json.loads(body)
                if found.get("status") == "error":
                    status = int(found.get("code", 400))
                    if status == 404:
                        return []
                    body = found.get("message", body)
                else:
                    return found.get("values") or []
            if not (status in (0, 429) or 500 <= status < 600):
                raise MarketApiError(f"{status}: {str(body)[:200]}")
            if attempt < RETRIES:
                self.sleep(2.0**attempt)
        raise MarketApiError(f"{status} after {RETRIES} retries")

    def fetch(self, symbol: str, interval: str, start: dt.datetime, end: dt.datetime) -> Iterator[dict]:
        """All values of a range; a full page is split, and one that can't be split any more is an error, as values may be missing."""
        rows = self.request(symbol, interval, start, end)
        if len(rows) >= self.page_rows:
            if end - start <= dt.timedelta(minutes=1):
                raise MarketApiError(f"a full page of {len(rows)} values from {start} to {end}")
            middle = start + (end - start) / 2
            yield from self.fetch(symbol, interval, start, middle)
            yield from self.fetch(symbol, interval, middle, end)
        else:
            yield from rows


def _when(text: str) -> dt.datetime:
    out = dt.datetime.fromisoformat(str(text).strip().replace("Z", "+00:00"))
    return out if out.tzinfo is None else out.astimezone(dt.timezone.utc).replace(tzinfo=None)


class _Range(InputPartition):
    def __init__(self, symbol: str, start: dt.datetime, end: dt.datetime) -> None:
        self.symbol, self.start, self.end = symbol, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.interval = normalize_interval(options.get("interval", "1day"))

    def partitions(self):
        start, end, n = _when(self.options["start"]), _when(self.options["end"]), int(self.options.get("partitions", "1"))
        if start > end:
            raise MarketApiError("start is after end")
        step = (end - start) / n
        return [_Range(normalize_symbol(s), start + k * step, start + (k + 1) * step) for s in self.options["symbols"].split(",") for k in range(n)]

    def read(self, partition):
        # Partitions may all run at once, so that together they keep the service's gap.
        tasks = len(self.options["symbols"].split(",")) * int(self.options.get("partitions", "1"))
        client = Client(self.options["base_url"], self.options.get("api_key", ""), gap=GAP_SECONDS * tasks)
        for v in client.fetch(partition.symbol, self.interval, partition.start, partition.end):
            def number(name, v=v):
                try:
                    return float(v[name])
                except (KeyError, TypeError, ValueError):
                    return None

            yield (_when(v["datetime"]), partition.symbol, *(number(c) for c in ("open", "high", "low", "close", "volume")))


class MarketSeries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "market_series"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def normalize(df: DataFrame) -> DataFrame:
    """Canonical types, rows without a price out, one row for each key (ranges meet at their ends)."""
    rows = canonical_columns(df).na.drop(subset=["timestamp", "asset_id", "open", "high", "low", "close"])
    return rows.groupBy("timestamp", "asset_id").agg(F.max(F.struct("open", "high", "low", "close", "volume")).alias("row")).select("timestamp", "asset_id", "row.*")


def values_to_dataframe(spark, values: list[dict], symbol: str) -> DataFrame:
    """Rows of one response."""
    raw = spark.createDataFrame([(json.dumps(v),) for v in values], "v string")
    fields = F.from_json("v", "datetime string, open string, high string, low string, close string, volume string").alias("v")
    return normalize(raw.select(fields).select(F.col("v.datetime").alias("timestamp"), F.lit(normalize_symbol(symbol)).alias("asset_id"), "v.open", "v.high", "v.low", "v.close", "v.volume"))


def save_responses(bars: DataFrame, path: str, *, interval: str = "1h") -> str:
    """Writes bars as the service's responses, a line of JSON for each asset and day (a day of bars of a minute or more is less than a page)."""
    day = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("datetime")
    value = F.struct(day, *(F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")))
    pages = bars.groupBy("asset_id", F.to_date("timestamp").alias("day")).agg(F.sort_array(F.collect_list(value)).alias("values"))
    meta = F.struct(F.col("asset_id").alias("symbol"), F.lit(normalize_interval(interval)).alias("interval"))
    pages.select(F.to_json(F.struct(meta.alias("meta"), "values", F.lit("ok").alias("status"))).alias("value")).write.text(path)
    return path


def load_responses(spark, path: str) -> DataFrame:
    """Canonical bars of recorded responses, a line of JSON each, from any store; parsed by Spark.

    A response of status 404 has no values. Other errors, and lines that are no response, fail the job when it reads them.
    """
    shape = "meta struct<symbol string>, values array<struct<datetime string, open string, high string, low string, close string, volume string>>, status string, code int, message string"
    r = spark.read.text(path).select("value", F.from_json("value", shape).alias("r"))
    bad = (F.coalesce("r.status", F.lit("")) != "ok") & (F.coalesce("r.code", F.lit(0)) != 404)
    refused = F.raise_error(F.concat(F.lit("no values in: "), F.substring("value", 1, 200))).cast("array<struct<datetime string, open string, high string, low string, close string, volume string>>")
    v = r.select(F.upper(F.trim("r.meta.symbol")).alias("asset_id"), F.explode(F.when(bad, refused).otherwise(F.col("r.values"))).alias("v"))
    price = (F.expr(f"try_cast(v.{c} AS double)").alias(c) for c in ("open", "high", "low", "close", "volume"))
    return normalize(v.select(F.expr("try_cast(v.datetime AS timestamp)").alias("timestamp"), "asset_id", *price))


def load_market_series(spark, symbols: str, interval: str, start: str, end: str, *, base_url: str, api_key: str = "", partitions: int = 1) -> DataFrame:
    spark.dataSource.register(MarketSeries)
    return normalize(spark.read.format("market_series").options(symbols=symbols, interval=interval, start=start, end=end, base_url=base_url, api_key=api_key, partitions=str(partitions)).load())
