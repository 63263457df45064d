"""Sharding by extendible hashing, in DataFrame operations only.

A document's key hash gives a string of bits. The directory starts with one
bucket; a bucket above the byte limit splits on its next hash bit, and only
that one, until every bucket fits. Sums by prefix decide all splits of sixteen
bits at once; documents of buckets that are still too large go to the next
round. What shares all bits of the hash (repeats of one id) cannot be split by
hashing and is cut into overflow links of the bucket by running size; only a
single document above the limit then stands alone above it.

Null ids hash as the empty string, null texts have 0 bytes, an empty table has
no shards. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltrace.runtime import materialize

#: Bits of the hash, and bits that one round can add to a bucket's prefix.
HASH_BITS, ROUND_BITS = 60, 15


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
    )


def _splits(sums: DataFrame, first: int, last: int, limit: int) -> DataFrame:
    """For each prefix of ``last`` bits, the shallowest bucket from ``first`` bits on that fits: (prefix, depth, shard_bytes)."""
    deep = sums.select(
        F.col("prefix").alias("leaf"), "leaf_bytes",
        F.explode(F.sequence(F.lit(first), F.lit(last))).alias("depth"),
    ).withColumn("bucket", F.call_function("shiftright", F.col("leaf"), F.lit(last) - F.col("depth")))
    fits = deep.groupBy("depth", "bucket").agg(F.sum("leaf_bytes").alias("shard_bytes")).filter(F.col("shard_bytes") <= limit)
    found = deep.join(fits, ["depth", "bucket"]).groupBy("leaf").agg(F.min(F.struct("depth", "shard_bytes")).alias("found"))
    return found.select(F.col("leaf").alias("prefix"), "found.depth", "found.shard_bytes")


def _running(rows: DataFrame) -> DataFrame:
    """Adds ``place`` and ``ahead``: rows and bytes before a row among those of its hash, smaller ones first.

    A hash with any share of the rows is dealt over many tasks in this order,
    and the sums of the tasks before are added.
    """
    order = ["n_bytes", "doc_id", "at"]
    parts = materialize(
        rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange("hash", *order).withColumn("part", F.spark_partition_id()), "shard-order")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    own = before.partitionBy("part", "hash").orderBy(*order)
    sums = parts.groupBy("part", "hash").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_bytes").alias("bytes"))
    of_hash = before.partitionBy("hash").orderBy("part")  # a row for each task that holds the hash
    sums = sums.select("part", "hash", F.coalesce(F.sum("rows").over(of_hash), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes").over(of_hash), F.lit(0)).alias("bytes"))
    local = parts.withColumn("place", F.count(F.lit(1)).over(own)).withColumn("ahead", F.coalesce(F.sum("n_bytes").over(own), F.lit(0)))
    return local.join(sums, ["part", "hash"]).select(*rows.columns, (F.col("place") + F.col("rows")).alias("place"), (F.col("ahead") + F.col("bytes")).alias("ahead"))


def shard(docs: DataFrame, max_bytes: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, depth, prefix, link, shard_bytes); (depth, prefix, link) names the shard.

    depth: bits of the bucket's prefix. link: 0, or the overflow link within a
    bucket whose documents share all bits.
    """
    if max_bytes < 1:
        raise ValueError("max_bytes must be positive")
    rest = materialize(_hashed(docs, id_col, text_col), "shard-hash")
    done: DataFrame | None = None
    for first in range(0, HASH_BITS, ROUND_BITS):
        last = first + ROUND_BITS
        prefix = F.shiftright("hash", HASH_BITS - last)
        sums = rest.groupBy(prefix.alias("prefix")).agg(F.sum("n_bytes").alias("leaf_bytes"))
        splits = materialize(_splits(sums, first + (first > 0), last, max_bytes), f"shard-splits-{first}")
        if first == 0:  # at most 2**15 rows of three longs
            splits = F.broadcast(splits)
        placed = rest.withColumn("leaf", prefix).join(splits.withColumnRenamed("prefix", "leaf"), "leaf", "left").drop("leaf")
        fits = placed.filter(F.col("depth").isNotNull()).select(
            "doc_id", "n_bytes", "depth", F.call_function("shiftright", F.col("hash"), F.lit(HASH_BITS) - F.col("depth")).alias("prefix"),
            F.lit(0).cast("long").alias("link"), "shard_bytes")
        done = fits if done is None else done.unionByName(fits)
        over = sums.join(splits, "prefix", "left_anti")
        if over.isEmpty():
            return done
        rest = materialize(placed.filter(F.col("depth").isNull()).select("doc_id", "hash", "n_bytes"), f"shard-rest-{last}")
    # What is left shares all bits: links of at most the limit, by running size.
    half = max(1, max_bytes // 2)
    linked = _running(rest).select(
        "doc_id", "hash", "n_bytes",
        F.when(F.col("n_bytes") > half, -F.col("place") - 1).otherwise(F.floor(F.col("ahead") / F.lit(half))).cast("long").alias("link"))
    linked = materialize(linked, "shard-links")
    # A link of empty texts may hold any number of rows: sums are joined back, not taken over a window.
    sizes = linked.groupBy("hash", "link").agg(F.sum("n_bytes").alias("shard_bytes"))
    chains = linked.join(sizes, ["hash", "link"]).select(
        "doc_id", "n_bytes", F.lit(HASH_BITS).alias("depth"), F.col("hash").alias("prefix"), "link", "shard_bytes")
    return done.unionByName(chains)


def directory(shards: DataFrame) -> DataFrame:
    """One row per shard: (depth, prefix, link, shard_bytes, n_docs); the global depth is the largest depth."""
    return shards.groupBy("depth", "prefix", "link").agg(F.max("shard_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("n_docs"))


def shard_name(depth: str = "depth", prefix: str = "prefix", link: str = "link"):
    """The prefix as bits, and the link if there is one; the empty prefix is ``-``."""
    bits = F.when(F.col(depth) == 0, F.lit("-")).otherwise(F.lpad(F.bin(prefix), F.col(depth), F.lit("0")))
    return F.when(F.col(link) == 0, bits).otherwise(F.concat_ws("+", bits, F.col(link).cast("string")))


def oracle_sql(max_bytes: int) -> str:
    """DuckDB SQL for the query over ``documents``, which has no two rows of one id."""
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
deep AS (SELECT doc_id, n_bytes, d AS depth, h >> (60 - d) AS prefix FROM docs, range(0, 61) t(d)),
sized AS (SELECT *, sum(n_bytes) OVER (PARTITION BY depth, prefix) AS shard_bytes FROM deep),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM sized WHERE shard_bytes <= {max_bytes})
SELECT doc_id, n_bytes, depth::INTEGER AS depth, CASE WHEN depth = 0 THEN '-' ELSE right(bin(prefix + (1::BIGINT << 60)), depth::INTEGER) END AS shard,
       shard_bytes::BIGINT AS shard_bytes FROM best WHERE k = 1
"""
