import importlib.util
import os
from collections import Counter

import pytest

import corpus_pipeline
from voltrace.llm import mixing, toxicity

_here = os.path.dirname(__file__)


def _load(name):
    spec = importlib.util.spec_from_file_location(name, os.path.join(_here, f"{name}.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, labels = _load("test_toxicity").corpus(240)
    rows = [(i, t, "en", f"s{i % 4}" if i % 3 else "hot", len(t)) for i, t, _ in docs]
    rows += [(500 + i, rows[7][1], "en", "hot", 1) for i in range(20)] + [(600, None, None, None, None), (601, "", "en", "s1", 0), (602, "a b c " * 4000, "en", "s2", 1), (7, rows[7][1], "en", "again", 1)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_against_brute_force(spark, tables):
    brute = _load("test_simhash")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    scores = {(r.doc_id, r.score) for r in toxicity.toxicity_scores(docs, spark.read.parquet(f"{tables}/labels.parquet")).collect()}
    bad = {i for i, s in scores if s >= corpus_pipeline.TOXIC_SCORE}
    stage = dict(corpus_pipeline.STAGES)

    clean = stage["toxicity"](spark, docs, tables)
    assert clean.columns == columns and bad
    rows = [tuple(r) for r in clean.collect()]
    assert Counter(r[:2] for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect() if r.doc_id not in bad)

    clean = spark.createDataFrame(rows, docs.schema)
    kept = stage["simhash"](spark, clean, tables)
    assert kept.columns == columns
    comp = brute.brute_similar([(r[0], r[1]) for r in rows])
    kept_rows = [tuple(r) for r in kept.collect()]
    assert sorted(r[0] for r in kept_rows) == sorted({i for i in comp if comp[i] == i})

    kept = spark.createDataFrame(kept_rows, docs.schema)
    mixed = stage["mixing"](spark, kept, tables)
    assert mixed.columns == columns
    plan = {r.doc_id: r.copies for r in mixing.mix(kept, tie=__import__("pyspark.sql.functions", fromlist=["x"]).expr("coalesce(md5(text), '')")).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in plan.items() if n})

    packed = stage["packing"](spark, mixed, tables).collect()
    tokens = Counter()
    for r in packed:
        tokens[r.doc_id] += len(r.ids) // 4
    assert set(tokens) == {i for i, n in plan.items() if n}
    whole = {r.doc_id: r.doc_tokens for r in packed}
    assert all(n == whole[i] * plan[i] for i, n in tokens.items())


def test_run_chains_the_stages(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.columns == ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
    filled = Counter()
    for r in out.collect():
        filled[r.sequence_id] += len(r.ids) // 4
    assert max(filled.values()) <= 2048


def test_run_on_an_empty_table(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
