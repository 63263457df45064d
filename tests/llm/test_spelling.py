import random
import re
import zlib
from collections import Counter

from voltrace.llm import spelling

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute_words(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_variants(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def text(rng, n):
    stems = ["ample", "orator", "àpèreur", "ÿyyÿyy", "wanderer", "colour", "ab"]
    made = []
    for _ in range(n):
        w = rng.choice(stems) + rng.choice(["", "s", "ing", "ers"])
        if rng.random() < 0.3:
            k = rng.randrange(len(w))
            w = w[:k] + rng.choice(["", "x", w[k] + "e"]) + w[k + 1:]
        made.append(w.upper() if rng.random() < 0.1 else w)
    return rng.choice([" ", "-", ", ", "×", "1"]).join(made)


def test_variants_of_texts(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, rng.randrange(1, 400))) for i in range(60)] + [(None, text(rng, 50)), (3, ""), (4, None), (7, text(rng, 30_000)), (8, "ÀÉÎabc " * 9), (8, "ÀÉÎabc " * 9)]
    df = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, word string").repartition(3)
    got = sorted(map(tuple, spelling.spelling_variants(df).collect()))
    assert got == sorted(brute_variants(brute_words(rows))) and any(g[1] for g in got)
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_every_edit_at_every_place(spark):
    """Dense words over two letters, all lengths from 2 on, with hot keys cut into parts, and chains of forms."""
    rng = random.Random(8)
    words = {"".join(rng.choice("aé") for _ in range(rng.randrange(2, 11))): rng.choice([1, 2, 5, 9, 30, 160, 900]) for _ in range(500)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = sorted((w, n, sum(one_edit(w, x) for x in words)) for w, n in words.items())
    for key_rows in (3, 2048):
        got = spelling.variants(df, key_rows=key_rows).collect()
        assert sorted((r.word, r.n, r.n_near) for r in got) == want
        assert sorted(map(tuple, got), key=str) == sorted(brute_variants(words), key=str)
    assert any(r.form and r.form != r.root for r in got)
    pairs = [frozenset((r.word, r.near)) for r in spelling.near_pairs(df, key_rows=7).collect()]
    assert len(pairs) == len(set(pairs)) == sum(w[2] for w in want) // 2
