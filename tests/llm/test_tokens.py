import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voltrace.llm import packing, tokencount
from voltrace.llm.units import units

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TEXTS = ["", None, " ", "  ", "a", "it's  we'll  'x", "a \n b\t c\n\n d ", "<|endoftext|>", "x <|endoftext|>  y<|endoftext|>", "Étion déjà 12½ ٣٤ 中文 字。 🙂 é ́", "a\x1c b \x85c　d",
         "word " * 3000, "z" * 5000, "rare qzxv, " * 7]


def want_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x1c\x85\xa0　'sdtre.,1½é中<|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_units_encode_alone(text):
    assert "".join(units(text)) == text and all(units(text))
    got = [i for e in TOKENIZER.encode_batch(units(text), add_special_tokens=False) for i in e.ids]
    assert got == want_ids(text)


@pytest.mark.parametrize("text", TEXTS)
def test_encoder_gives_the_librarys_ids(text):
    assert np.frombuffer(packing.encoder(PATH)(text or ""), "<u4").tolist() == want_ids(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x1c\x85\xa0　'sdtre.,1½é中<|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_encoder_on_any_text(text):
    assert np.frombuffer(packing.encoder(PATH)(text), "<u4").tolist() == want_ids(text)


@pytest.mark.parametrize("text", ["a" + " " * 1_200_000 + "b <|endoftext|>", "\n" * 1_200_000, "x" + "\t" * 100_000 + " y", " " * 99_999 + "z", "z" * 1_200_000])
def test_encoder_on_very_long_runs(text):
    encode = packing.encoder(PATH)
    assert np.frombuffer(encode(text), "<u4").tolist() == want_ids(text)
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    assert encode.ids(text, special=False).tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("head_rows", [3, 1 << 18])
def test_counts(spark, head_rows):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "y"), (3, "  ", "z"), (4, "again", None), (77, "a b", "u"), (77, "a b", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, unit string").repartition(3)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.token_counts(df, PATH, head_rows=head_rows).collect())
    assert got == sorted((str(i), len((t or "").encode()), len(want_ids(t)), len(want_ids(t)) > 1024) for i, t, _ in rows)


def test_counts_of_sentencepiece_and_empty(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(df, path).collect()}
    assert got == {i: len(sp.encode(t or "")) for i, t in enumerate(TEXTS)}
    assert tokencount.token_counts(df.limit(0), PATH).count() == 0


def naive_first_fit(lengths, capacity):
    free, out = [], {}
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        b = next((b for b, f in enumerate(free) if f >= lengths[k]), len(free))
        if b == len(free):
            free.append(capacity)
        out[k] = (b, capacity - free[b])
        free[b] -= lengths[k]
    return [out[k] for k in range(len(lengths))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_tournament_tree_is_first_fit(lengths):
    bins, offsets = packing.first_fit_decreasing(np.array(lengths, dtype=np.int64), 50)
    assert list(zip(bins.tolist(), offsets.tolist())) == naive_first_fit(lengths, 50)


def test_packing_keeps_every_id_once(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (77, "a b"), (77, "a b")] + [(1000 + i, "w " * (i * 7 % 500)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = packing.pack(df, PATH).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        by_seq[r.sequence_id].append((r.offset, len(r.ids) // 4))
    for i, t in rows:
        copies = sum(j == i for j, _ in rows)
        assert sorted(x for _, p in sorted(by_doc[i]) for x in p) == sorted((want_ids(t) + [1]) * copies)
        if copies == 1:
            assert [x for _, p in sorted(by_doc[i]) for x in p] == want_ids(t) + [1]
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    digest = packing.packing_digest(df, PATH).collect()
    assert sorted((str(r.doc_id), r.start, r.ids_crc32) for r in digest) == sorted((str(r.doc_id), r.start, zlib.crc32(r.ids)) for r in out)
    assert packing.packing_digest(df.limit(0), PATH).count() == 0


def test_repeated_rows_are_dealt_over_groups(spark):
    df = spark.createDataFrame([(5, "a b", "g")] * 900, "doc_id long, text string, group string").repartition(3)
    cut = packing.pieces(df, PATH, n_groups=30).groupBy("group").count().collect()
    assert sum(r["count"] for r in cut) == 900 and len(cut) == 30 and max(r["count"] for r in cut) < 90
    again = packing.pieces(df.orderBy("text"), PATH, n_groups=30)
    assert again.count() == 900
    assert packing.pack(df, PATH).count() == 900


def test_groups_do_not_depend_on_the_order_of_rows(spark):
    rows = [(k % 40, "a b" if k % 3 else f"text {k % 7}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    dealt = [Counter((r.doc_id, bytes(r.ids), r.group) for r in packing.pieces(d, PATH, n_groups=50).collect()) for d in (df, spark.createDataFrame(rows[::-1], df.schema).coalesce(1))]
    assert dealt[0] == dealt[1]
