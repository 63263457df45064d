import math
import random
import zlib

import pytest

from voltrace.llm import toxicity

PLAIN = "lorem ipsum dolor sit amet consectetur elit sed eiusmod tempor incididunt labore magna aliqua enim minim veniam quis".split()
BAD = ("vermin", "dunce", "oaf")


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(PLAIN) + rng.choice(["", "a", "o", "us"]) for _ in range(rng.randrange(8, 80))]
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(max(2, len(words) // 30)):
                words[rng.randrange(len(words))] = rng.choice(BAD) if i % 12 else "zorg" + rng.choice(["a", "ul", "em", "isk"])
        docs.append((i, " ".join(words), "x"))
        labels.append((i, toxic))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_fold():
    assert toxicity.fold("Ｖ3rm1n  dünce! o*a*f ѕсum") == " vermin dunce oaf scum " or toxicity.fold("V3rm1n dünce, o*a*f") == " vermin dunce oaf "
    assert toxicity.fold("") == "  " and toxicity.fold("а​b") == " ab "


def test_signs_stand_for_letters_in_words_only():
    assert toxicity.fold("you stupid! idiot!! $5.00 1984 - 3:30") == " you stupid idiot "
    assert toxicity.fold("$tup1d, (st@pid) !diot! b@d!s") == " stupid stapid idiot badis "
    m = toxicity.Model({" stupid ": (5.0, True)})
    assert m.evidence(toxicity.fold("you stupid!")) == m.evidence(toxicity.fold("you stupid")) == m.evidence(toxicity.fold("you 5tup1d!!"))


def brute_evidence(m, text):
    """Every entry at every place of the folded text, the longest of a place, outside all exceptions."""
    folded = toxicity.fold(text)
    spans = [(k, k + len(toxicity.fold(e)) - 1) for e in m.exceptions for k in range(len(folded)) if folded.startswith(toxicity.fold(e), k)]
    hits = []
    for k in range(len(folded)):
        here = [e for e in m.entries if folded.startswith(e, k)]
        if here:
            e = max(here, key=len)
            if not any(a <= k and k + len(e) - 1 <= b for a, b in spans):
                hits.append(m.entries[e])
    words = max(1, len(folded.split()))
    telling, dense = [w for w, t in hits if t], [w for w, t in hits if not t]
    return (math.log1p(sum(telling)), min(toxicity.MOST_SHARE, len(telling) / words), min(toxicity.MOST_DENSE, sum(dense) / words) if len(dense) > 1 else 0.0, math.log(words))


def test_automaton_against_every_place():
    rng = random.Random(6)
    parts = ["dunce", "dun", "oaf", "loaf", "cap", "Düncé", "d*unce!", "0af", "a", "42", "ver", "vermin"]
    m = toxicity.Model({" dunce ": (5.0, True), " dun": (2.0, False), " oaf ": (3.5, True), " vermin": (4.0, False), " ver": (1.5, True)}, ("dunce cap", "a oaf"))
    for _ in range(400):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 30)))
        assert m.evidence(toxicity.fold(text)) == pytest.approx(brute_evidence(m, text)), text


def test_exceptions_are_learned(spark):
    docs, labels = corpus()
    clean = [i for i, t in labels if not t][:90]
    docs = [(i, t + " the oaf tree stands" if i in clean else t, x) for i, t, x in docs]
    model = toxicity.fit(*frames(spark, docs, labels))
    assert "oaf tree" in model.exceptions and not any("vermin" in e for e in model.exceptions if model.score(e) > 0.9)
    plain = " ".join(PLAIN * 2)
    assert model.score(plain + " the oaf tree stands") < 0.5 < model.score(plain + " oaf you oaf dunce vermin")


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, lab = frames(spark, docs, labels)
    truth = dict(labels)
    got = toxicity.toxicity_scores(d, lab).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert not any(r.predicted for r in held if not truth[r.doc_id])
    # Labels of held-out rows change nothing.
    other = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    again = toxicity.toxicity_scores(*frames(spark, docs, other)).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in got}


def test_disguise_and_exceptions():
    m = toxicity.Model({" dunce ": (5.0, True)}, ("dunce cap",), (2.0, 1.0, 0.0, 0.0, -3.0))
    clean = m.score("a quiet day")
    assert m.score("you dunce") > 0.3 > clean and m.score("you dυnсе") == m.score("you dunce") == m.score("you d u-nce".replace(" u-", "*u"))
    assert m.score("a dunce cap there") == m.score("a calm day there") and m.score("a dunce cap, dunce") > m.score("a calm day, calm")


def test_edge_cases(spark):
    docs, labels = corpus(120)
    docs += [(1000, None, "n"), (1001, "", "e"), (None, "no id", "i"), (0, docs[0][1], "again"), (1002, "vermin " * 20000, "long")]
    got = toxicity.toxicity_scores(*frames(spark, docs, labels + [(0, 0), (1, None), (None, 1)])).collect()
    assert len(got) == len(docs)
    scores = {}
    for r in got:
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert scores[1000] == scores[1001] and len(scores[0]) == 1
    d, lab = frames(spark, docs, labels)
    assert toxicity.toxicity_scores(d.limit(0), lab).count() == 0
    none = toxicity.toxicity_scores(d, lab.filter("toxic = 0")).collect()
    assert len({r.score for r in none}) == 1 and not any(r.predicted for r in none)
