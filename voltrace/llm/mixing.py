"""Mixing sources to target weights by capped water-filling.

Sources get shares of a total in proportion to their weights; a source whose
share exceeds ``max_epochs`` times its own size is clamped there and what it
leaves is shared again among the others, until none is above its cap. A target
of r times a source's size takes every document floor(r) times, and a seeded
choice of documents once more, so that their sizes sum to the fraction's share.

Null and empty texts have size 0. Null sources form one source, ranked last.
Repeated rows count and are chosen each on its own. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrace.runtime import materialize

#: Hash digits that split a source's documents into buckets of the choice.
BUCKET_DIGITS = 4


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def rank_sources(sources: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0, by code point of ``source``, null last; no row meets all others in one task.

    Rows are range-partitioned; ranks are the row number within a partition
    plus the sizes of the partitions before it.
    """
    ordered = [F.col("source").isNull().asc(), F.col("source").asc()]
    parts = materialize(
        sources.repartitionByRange(*ordered).withColumn("part", F.spark_partition_id())
        .withColumn("in_part", F.row_number().over(Window.partitionBy("part").orderBy(*ordered))),
        "mix-ranked",
    )
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.withColumn("before", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(F.broadcast(before), "part").select(*sources.columns, (F.col("in_part") + F.col("before") - 1).alias("rank"))


def water_fill(sources: DataFrame, total: int, max_epochs: int = 3) -> DataFrame:
    """Adds ``target`` to rows of (source, source_size, weight).

    Each round is one aggregate over the sources; only its sums come to the
    driver. Clamping is monotone, so the rounds end at the unique solution.
    """
    cap = F.col("source_size") * max_epochs
    left, weights = total, None
    free = F.lit(True)
    clamped = -1
    while True:
        row = sources.agg(
            F.sum(F.when(free, F.col("weight"))).alias("w"),
            F.sum(F.when(~free, cap)).alias("c"),
            F.count_if(~free).alias("n"),
        ).first()
        left, weights = total - (row.c or 0), row.w
        if row.n == clamped or not weights:
            break
        clamped = row.n
        free = (cap * F.lit(weights)) > (F.col("weight") * F.lit(left))
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(weights or 1))
    return sources.withColumn("target", F.when(free, share).otherwise(cap.cast("double")))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
        text_col: str = "text", seed: str = "0", max_epochs: int = 3, weight_cycle: int = 3, tie: Column | None = None) -> DataFrame:
    """Rows (doc_id, tie, size, source_size, target, copies): how often the mix takes each document.

    tie: tells rows of the same id apart where their texts matter to the caller.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        (word_count(F.col(text_col)) if size is None else size).alias("size"),
        (F.lit("") if tie is None else tie).alias("tie"),
    )
    base = materialize(base, "mix-sizes")
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = rank_sources(sums).withColumn("weight", F.col("rank") % weight_cycle + 1).drop("rank")
    ranked = materialize(ranked, "mix-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    plan = water_fill(ranked, total, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(ratio)).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))

    draw = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("tie")))
    rows = base.withColumn("draw", draw).withColumn("bucket", F.substring("draw", 1, BUCKET_DIGITS))
    # The choice goes by documents in the order of their draws. Sums by bucket show the one
    # bucket of a source in which its need is met, so only that one is put in order.
    by_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = (
        by_bucket.withColumn("before", before)
        .join(plan.select(F.col("source").alias("s"), "need"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .filter(F.col("before") <= F.col("need"))
        .groupBy("source").agg(F.max("bucket").alias("edge"), F.max_by("before", "bucket").alias("edge_before"))
    )
    plan = plan.join(edge.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    # Sources are few against documents but without a fixed bound: the planner decides by measured size, and splits a hot source.
    plan = materialize(plan, "mix-plan").withColumnRenamed("source", "s")
    full = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    clear = full.filter(F.col("bucket") != F.col("edge")).withColumn("extra", (F.col("bucket") < F.col("edge")).cast("long"))
    in_order = Window.partitionBy("source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    close = (
        full.filter(F.col("bucket") == F.col("edge"))
        .withColumn("ahead", F.col("edge_before") + F.coalesce(F.sum("size").over(in_order), F.lit(0)))
        .withColumn("extra", (F.col("ahead") * 2 + F.col("size") <= F.col("need") * 2).cast("long")).drop("ahead")
    )
    return clear.unionByName(close).select(
        "doc_id", "tie", "size", "source_size", "target", (F.col("whole") + F.col("extra")).cast("long").alias("copies"))


def mixture_digest(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every document."""
    return mix(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: DuckDB SQL for mixture_digest(documents).
ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, '') || ':') AS draw
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, (SELECT sum(size) FROM base)::BIGINT AS total FROM sums),
steps AS (
  SELECT *, coalesce(sum(3 * source_size) OVER w, 0)::BIGINT AS capped, (SELECT sum(weight) FROM ranked) - coalesce(sum(weight) OVER w, 0) AS weights
  FROM ranked WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, 3 * source_size * weights <= weight * (total - capped) AS clamp FROM steps),
rest AS (SELECT max(total) - coalesce(sum(3 * source_size) FILTER (clamp), 0) AS left_over, sum(weight) FILTER (NOT clamp) AS weights FROM marked),
plan AS (
  SELECT source, source_size, CASE WHEN clamp THEN (3 * source_size)::DOUBLE ELSE (weight * rest.left_over)::DOUBLE / rest.weights::DOUBLE END AS target FROM marked, rest),
needs AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)::BIGINT AS whole FROM plan),
ordered AS (
  SELECT b.*, n.source_size, n.target, n.whole, n.target - n.whole * n.source_size AS need,
         coalesce(sum(size) OVER (PARTITION BY b.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM base b JOIN needs n ON b.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN ahead * 2 + size <= need * 2 THEN 1 ELSE 0 END))::BIGINT AS taken FROM ordered
"""
