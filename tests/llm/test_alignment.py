import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voltrace.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BPE, PIECES = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
BPE.encode_special_tokens = True
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BACK = {chr(b): b for b in VISIBLE} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in VISIBLE)}
TEXTS = ["plain words here", "", None, " two  spaces ", "x<|endoftext|>y <s>z</s> <0x41>", "a▁b", "Étion déjà 12½ 中文 字。 🙂 é́", "tab\tline\n\r\n ", "z" * 3000, "the the the the", "word other " * 2000]


def brute(text):
    """Tokens of both sides as (id, bytes), by the libraries; none if the bytes differ."""
    if not text:
        return [], []
    a = [(i, bytes(BACK[c] for c in BPE.id_to_token(i))) for i in BPE.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(PIECES.id_to_piece(i)[3:-1], 16)]) if PIECES.is_byte(i) else PIECES.id_to_piece(i).replace("▁", " ").encode()) for i in PIECES.encode(text)]
    want = b" " + text.encode()
    return (a, b) if b"".join(x for _, x in a) == want and b"".join(x for _, x in b) == want else ([], [])


def spans(tokens):
    out, at = [], 0
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def digests(rows):
    """What the query returns for (id, text) rows, by loops over all pairs of tokens."""
    links, out = {}, []
    for k, (_, text) in enumerate(rows):
        a, b = map(spans, brute(text))
        by_end = {end: i for i, _, end in b}
        links[k] = [(i, by_end[end]) for i, _, end in a if end in by_end]
    count = Counter(p for found in links.values() for p in found)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    for k, (key, text) in enumerate(rows):
        a, b = map(spans, brute(text))
        common = sorted({e for _, _, e in a} & {e for _, _, e in b})
        cuts, groups = [0, *common], []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            inside = [[str(i) for i, _, e in side if lo < e <= hi] for side in (a, b)]
            groups.append("|".join(map(",".join, inside)))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((key, len(a), len(b), len(groups), len(links[k]), sum(count[p] == best[p[1]] for p in links[k]), sum(count[p] for p in links[k]), digest))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x1c\x85\xa0　'sdtre.,1½é中▁<|endoftext|></s>0xAF"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_units_of_both_sides_encode_as_the_whole_text(text):
    got = alignment.encoder(A, B)(text)
    a, b = brute(text)
    assert ([], []) == (a, b) if got is None else [x.tolist() for x in got] == [[i for i, _ in side] for side in (a, b)]


@pytest.mark.parametrize("head_pairs", [2, 1 << 19])
def test_digests_against_loops(spark, head_pairs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (0, "plain words here"), (0, "plain words here")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string").repartition(3)
    got = alignment.alignment(df, A, B, head_pairs=head_pairs).drop("n_overlaps", "n_shared").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, digests(rows)))
    assert alignment.alignment(df.limit(0), A, B).count() == 0


def test_links_against_loops(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS[:8])], "doc_id long, text string")
    for kind in ("overlap", "end", "group"):
        want = set()
        for k, text in enumerate(TEXTS[:8]):
            a, b = map(spans, brute(text))
            common = sorted({e for _, _, e in a} & {e for _, _, e in b})
            for x, (i, s, e) in enumerate(a):
                for y, (j, t, f) in enumerate(b):
                    shared = min(e, f) - max(s, t)
                    same = np.searchsorted(common, e) == np.searchsorted(common, f)
                    if {"overlap": shared > 0, "end": e == f, "group": same}[kind]:
                        want.add((k, x, y, i, j, None if kind == "group" else shared))
        got = [tuple(r) for r in alignment.token_links(df, A, B, kind).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        if kind != "end":
            name = {"overlap": "n_overlaps", "group": "n_shared"}[kind]
            assert {r.doc_id: r[name] for r in alignment.alignment(df, A, B).collect() if r[name]} == Counter(w[0] for w in want)
    with pytest.raises(ValueError):
        alignment.token_links(df, A, B, "none")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(1, 6), st.integers(0, 2**32), st.integers(1, 50))
def test_products_against_dense(n, k, m, seed, block):
    rng = np.random.default_rng(seed)
    x, y = (np.where(rng.random(shape) < 0.5, rng.integers(1, 5, shape), 0) for shape in ((n, k), (k, m)))

    def csr(d):
        return alignment.Csr(np.concatenate(([0], np.cumsum((d > 0).sum(axis=1)))), np.nonzero(d)[1], d[d > 0])

    out = np.zeros((n, m), dtype=int)
    for i, j, v in alignment.gustavson(csr(x), csr(y), m, block):
        assert not out[i, j].any()
        out[i, j] = v
    assert (out == x @ y).all()
    back = csr(x).transpose(k)
    assert back.indptr.tolist() == csr(x.T).indptr.tolist() and back.indices.tolist() == csr(x.T).indices.tolist() and back.data.tolist() == csr(x.T).data.tolist()
