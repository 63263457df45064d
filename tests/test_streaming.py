import datetime as dt

from pyspark.sql import functions as F

from voltrace.operators import ewma
from voltrace.streaming.bars import streaming_bars, streaming_ewma

T0 = dt.datetime(2024, 1, 1)


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_bars_close_with_the_watermark(spark, tmp_path):
    rows = [(k, T0 + dt.timedelta(minutes=20 * k), "a", float(k + 1)) for k in range(15)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in")
    got = {r.timestamp: (r.open, r.high, r.low, r.close, r.volume) for r in drain(streaming_bars(stream), "bars").collect()}
    assert got[T0] == (1.0, 3.0, 1.0, 3.0, 3.0) and T0 + dt.timedelta(hours=4) not in got


def test_state_carries_the_variance(spark, tmp_path):
    rows = [("A", T0 + dt.timedelta(days=k), 0.01 * (k % 5 - 2)) for k in range(40)]
    schema = "asset_id string, timestamp timestamp, return double"
    for part in range(2):
        spark.createDataFrame(rows[part * 20:part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = drain(streaming_ewma(stream), "ewma").orderBy(F.desc("timestamp")).first().variance
    want = ewma.calculate_ewma(spark.createDataFrame(rows, schema)).first().ewma_variance
    assert abs(got - want) < 1e-12
