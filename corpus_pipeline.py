"""Corpus pipeline over ``documents``: toxicity, SimHash near-dedup, mixing, packing.

Each stage takes all rows that the one before it kept, written as Parquet and
read again, and its decisions take effect. All stages but the last return the
columns of documents; packing returns a row for each piece of a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrace.llm import mixing, packing, simhash, toxicity
from voltrace.llm.queries import tokenizer_path
from voltrace.runtime import materialize, table

TOXIC_SCORE = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_scores(docs, model, name="__toxic_score")
    return scored.filter(F.col("__toxic_score") < TOXIC_SCORE).drop("__toxic_score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more of their five-word shingles, the one with the smallest id."""
    groups = materialize(simhash.similar_groups(docs), "pipeline-groups")
    return simhash.first_of_each_group(docs, groups)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those that it takes no time go.

    Sizes are words. Rows that repeat both id and text are one row to the mix's result: it has as many copies as they get together.
    """
    tie = F.coalesce(F.md5("text"), F.lit(""))
    plan = mixing.mix(docs, tie=tie).groupBy(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie")).agg(
        F.sum("copies").alias("__sum"), F.count(F.lit(1)).alias("__rows"))
    plan = materialize(plan, "pipeline-plan")
    out = docs.withColumn("__md5", tie).join(plan, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__md5") == F.col("__tie"))).filter("__sum > 0")
    if not plan.filter("__rows > 1").isEmpty():
        out = out.filter("__rows = 1").unionByName(out.filter("__rows > 1").dropDuplicates(["doc_id", "__md5"]))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__sum").cast("int")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids and places in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: The toxicity score can't be expressed in SQL; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
