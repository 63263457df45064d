import random
import zlib

import numpy as np

from voltrace.llm import langid

SOUNDS = {"xa": ("ka", "ri", "to", "mun"), "xb": ("ke", "ru", "to", "sel"), "xc": ("ħa", "zer", "né", "ol")}


def text_of(lang, rng, words=12):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(words)).capitalize() + "."


def corpus(n=300):
    rng = random.Random(4)
    rows = [(i, text_of(lang, rng, rng.randrange(3, 30)), lang) for i in range(n) for lang in [rng.choice(list(SOUNDS))]]
    return rows + [(None, text_of("xa", rng), "xa"), (n, "", "xa"), (n + 1, None, "xb"), (n + 2, "12 34 — ²", "xb"), (n + 3, text_of("xb", rng), None), (n + 4, "中文", "xc"), (n + 5, text_of("xc", rng, 20_000), "xc"), (5, rows[5][1], rows[5][2])]


def brute_grams(text):
    low = text.lower()
    kept = " " + " ".join("".join(c if c.isalpha() else " " for c in low).split()) + " "
    for n in langid.LENGTHS:
        for i in range(len(kept) - n + 1):
            g = kept[i:i + n]
            if any(c != " " for c in g) and " " not in g[1:-1]:
                yield n, g


def test_grams_against_strings():
    rng = random.Random(1)
    for text in ["", " ", "a", "Ab c", "x  1y", "İ ß ǅ", *["".join(rng.choice("ab é1.中🙂") for _ in range(40)) for _ in range(30)]]:
        want = list(brute_grams(text))
        got = [h for part in langid.grams(langid.normalised(text)) for h in part.tolist()]
        assert len(got) == len(want) and len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_blocks_lose_no_gram(monkeypatch):
    text = "ab cde fghij k " * 9
    want = sorted(h for part in langid.grams(langid.normalised(text)) for h in part.tolist())
    for block in (5, 7, 16, 64):
        monkeypatch.setattr(langid, "BLOCK_CHARS", block)
        assert sorted(h for part in langid.grams(langid.normalised(text)) for h in part.tolist()) == want


def test_filter_returns_all_languages_and_corrects_chance():
    rng = np.random.default_rng(5)
    members = {f"l{k:02}": rng.integers(0, 2**63, 3000, dtype=np.uint64) for k in range(11)}
    members["l03"][:1000] = members["l07"][:1000]
    made = langid.Filter.build(members, "l00")
    for k, name in enumerate(made.languages):
        assert ((made.containing(members[name])[:, k // 8] >> (k % 8)) & 1).all()
    strange = rng.integers(0, 2**63, 200_000, dtype=np.uint64)
    seen = made.containing(strange)
    for k in range(11):
        assert abs(((seen[:, k // 8] >> (k % 8)) & 1).mean() - made.chance[k]) < 0.004


def want_prediction(rows):
    """Predictions by sets of strings, without filters, hashes or Spark."""
    known = [(t, lang) for i, t, lang in rows if lang is not None and t is not None and zlib.crc32(b"" if i is None else str(i).encode()) % 5]
    counts, totals, learned = {}, {}, {}
    for t, lang in known:
        learned[lang] = learned.get(lang, 0) + 1
        for n, g in brute_grams(t):
            counts[lang, g] = counts.get((lang, g), 0) + 1
            totals[lang, n] = totals.get((lang, n), 0) + 1
    rates = {(lang, g): c / totals[lang, len(g)] for (lang, g), c in counts.items() if c / totals[lang, len(g)] >= langid.LEAST_RATE}
    best = {}
    for (_, g), r in rates.items():
        best[g] = max(best.get(g, 0), r)
    has = {key for key, r in rates.items() if r >= langid.LEAST_PART * best[key[1]]}
    out = []
    for i, t, _ in rows:
        if t is None or not any(c.isalpha() for c in t):
            out.append((i, "und", 0.0))
            continue
        grams = [g for _, g in brute_grams(t)]
        shares = {lang: sum((lang, g) in has for g in grams) / len(grams) for lang in sorted(learned)}
        total = sum(shares.values())
        pick = max(sorted(shares), key=shares.get) if total else max(sorted(learned), key=learned.get)
        out.append((i, pick, shares[pick] / total if total else 0.0))
    return out


def test_predictions_against_sets(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, source string, score double").repartition(3)
    got = sorted((str(r.doc_id), r.lang_pred, r.held_out, r.score) for r in langid.languages(df).collect())
    want = sorted((str(i), lang, zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0, s) for i, lang, s in want_prediction(rows))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert max(abs(g[3] - w[3]) for g, w in zip(got, want, strict=True)) < 0.03 and all(0 <= g[3] <= 1 for g in got)
    named = {str(i): lang for i, t, lang in rows if lang and t and len(t) > 20}
    right = [named[g[0]] == g[1] for g in got if g[2] and g[0] in named]
    assert len(right) > 30 and sum(right) / len(right) > 0.95


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.languages(df).collect()} == {("und", 0.0)}
    assert langid.languages(df.limit(0)).count() == 0


def test_learning_ignores_held_out_rows_and_other_columns(spark):
    rows = corpus(120)
    wrong = [(i, t, "xz" if zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    schema = "doc_id long, text string, lang string"
    got = [sorted((str(r.doc_id), r.lang_pred, r.score) for r in langid.languages(spark.createDataFrame(x, schema)).collect()) for x in (rows, wrong)]
    assert got[0] == got[1]
