"""The registered queries of this subpackage, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from voltrace.llm import alignment, chat, itq, ivfpq, langid, licenses, mixing, packing, sharding, simhash, spelling, tokencount, toxicity
from voltrace.runtime import table

#: Limit of a shard, in bytes of text: small objects, as for range reads over HTTP.
SHARD_BYTES = 1 << 20


#: Files of the tokenizer that token counts and packing use, and of the one that it is aligned with.
TOKENIZER, OTHER_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    # Two layouts, each mapped by its fingerprint: a table of rows by turn, and JSON records with an array of messages.
    record = json.dumps({"messages": [{"role": "human", "content": hard}, {"role": "gpt", "content": hard}]})
    extra = chat.turns_from_json(spark.createDataFrame([(-7, record)], "conv_id long, record string"), "conv_id", "record")
    turns = chat.canonical_turns(table(spark, sf_dir, "conversations")).unionByName(extra.select("conv_id", "turn", "role", "text"))
    return chat.conversation_digest(chat.format_turns(turns))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)
    return shards.select("doc_id", "n_bytes", "depth", sharding.shard_name().alias("shard"), "shard_bytes")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_digest(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(OTHER_TOKENIZER))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_chat_formatting, op2_nearest_neighbours, op3_token_counts, op4_sharding, op5_license_scan,
    op6_simhash, op7_mixing, op8_packing, op9_toxicity, op10_embedding_dedup, op11_tokenizer_alignment, op12_language_id, op13_spelling_variants)}
ORACLES = {"op4_sharding": sharding.oracle_sql(SHARD_BYTES), "op7_mixing": mixing.ORACLE_SQL}
