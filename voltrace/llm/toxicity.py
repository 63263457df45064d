"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded: accents and case go, look-alike letters and the digits and
signs that stand for letters become those letters (in words only: not in
numbers and prices, nor where a sign closes a word), masks inside a word vanish.
The lexicon is learned from labelled texts: whole words and word beginnings
that toxic texts use far more often than others get their smoothed log-odds as
weight. One automaton per model finds all entries in a folded text; of the
entries that begin at one place the longest counts. Exception phrases cover
the words that they span: an entry inside one does not count. They are given,
or learned: an entry with the word before or after it, met in several clean
texts and in no toxic one.

Evidence is normalised by length. Entries are of two kinds: telling ones, of
which one occurrence says much, and dense ones, also met in clean texts by
chance, which count by their share of the words. A logistic curve over
(telling weight, telling share, dense share, log words), fitted on the same
rows, gives scores from 0 to 1.

Null texts count as empty and get the score of a text without evidence.
Without any toxic labelled text all scores are the share of toxic labels,
smoothed. Repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltrace.runtime import materialize

#: Most labelled rows that the model is fitted on, of each label, by a hash of their ids. Entries and exceptions are as many as these texts support.
FIT_ROWS = 10_000
#: Clean texts that an exception phrase is met in at least.
LEAST_CLEAN = 3
#: Distinct entries that a task counts before it passes them on.
FLUSH_ROWS = 50_000
#: Set by hand; how they were chosen is not recorded, so held-out figures may flatter them.
#: An entry is kept if its log-likelihood gain over chance reaches LEAST_GAIN (telling, dense) and its log-odds LEAST_ODDS;
#: it is dense in a text with two occurrences or more and this share of the words. The share of telling entries counts up to MOST_SHARE,
#: that of dense ones, times their weights, up to MOST_DENSE.
LEAST_GAIN, LEAST_ODDS, LEAST_SHARE, MOST_SHARE, MOST_DENSE = (11.0, 6.5), (3.5, 2.5), 0.004, 0.008, 0.05
#: Lengths of word beginnings that may become entries.
PREFIXES = range(4, 10)

#: Digits and signs that stand for letters in words, and letters of other scripts that look like Latin ones.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o",
}
#: Marks that are dropped inside words: combining accents, zero-width characters and signs used as masks.
DROPPED = "*#_~^­​‌‍⁠﻿"


class _Fold(dict):
    """A translation table that grows by the characters it meets (at most all code points)."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code).lower()):
            c = SUBSTITUTES.get(c, HOMOGLYPHS.get(c, c))
            out += "" if c in DROPPED or unicodedata.combining(c[0]) else c if c.isalpha() else " "
        self[code] = out
        return out


_FOLD = _Fold()
#: A run of ASCII digits and signs without a letter (a number, a price, a mark), and signs that close a word.
_NO_WORD = re.compile(r"(?<!\S)[!-@\[-`{-~]+(?!\S)")
_CLOSING = re.compile(r"[!|$@](?=[!-/:-@\[-`{-~]*(?:\s|$))")


def fold(text: str) -> str:
    """Folded words, lower case, each after one space, and a space at the end."""
    return " " + " ".join(_CLOSING.sub(" ", _NO_WORD.sub(" ", text)).translate(_FOLD).split()) + " "


@dataclass(frozen=True)
class Model:
    """entries: folded text (a leading space ties it to a word's start, a closing one to its end) to (weight, is it telling)."""

    entries: dict[str, tuple[float, bool]]
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, 0.0)
    mean: tuple[float, ...] = (0.0,) * 4
    scale: tuple[float, ...] = (1.0,) * 4
    _automaton: list = field(default_factory=list, compare=False, repr=False)

    def automaton(self):
        if not self._automaton:
            import ahocorasick

            made = ahocorasick.Automaton()
            for phrase in self.exceptions:
                made.add_word(fold(phrase), (len(fold(phrase)), None, True))
            for text, (weight, telling) in self.entries.items():
                made.add_word(text, (len(text), weight, telling))
            if len(made):
                made.make_automaton()
            self._automaton.append(made)
        return self._automaton[0]

    def __getstate__(self):
        return self.__dict__ | {"_automaton": []}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def phrases(self, folded: str) -> set[str]:
        """The words that hold entries, each with the word before and with the one after it."""
        made, out = self.automaton(), set()
        for end, (size, weight, _) in made.iter(folded) if len(made) else ():
            if weight is None:
                continue
            start = end - size + 2 if folded[end - size + 1] == " " else folded.rfind(" ", 0, end - size + 1) + 1
            stop = folded.find(" ", start)
            before, after = folded.rfind(" ", 0, max(0, start - 1)), folded.find(" ", stop + 1)
            if start > 1:
                out.add(folded[before + 1:stop])
            if after > 0:
                out.add(folded[start:after])
        return out

    def evidence(self, folded: str) -> tuple[float, float, float, float]:
        """Log of the telling entries' weight, their share of the words, the dense ones' weight by word, log of the words."""
        made, words = self.automaton(), max(1, folded.count(" ") - 1)
        found: dict[int, tuple[int, float, bool]] = {}
        spans = []
        if len(made):
            for end, (size, weight, telling) in made.iter(folded):
                start = end - size + 1
                if weight is None:
                    spans.append((start, end))
                elif start not in found or found[start][0] < size:
                    found[start] = (size, weight, telling)
        if spans:
            found = {s: v for s, v in found.items() if not any(a <= s and s + v[0] - 1 <= b for a, b in spans)}
        telling = [w for _, w, t in found.values() if t]
        dense = [w for _, w, t in found.values() if not t]
        return (math.log1p(sum(telling)), min(MOST_SHARE, len(telling) / words), min(MOST_DENSE, sum(dense) / words) if len(dense) > 1 else 0.0, math.log(words))

    def score(self, text: str | None) -> float:
        x = (np.array(self.evidence(fold(text or ""))) - self.mean) / self.scale
        z = float(np.dot(x, self.coefficients[:4]) + self.coefficients[4])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _candidates(text: str) -> tuple[Counter[str], int]:
    """Occurrences of words and word beginnings, and the number of words."""
    out: Counter[str] = Counter()
    words = fold(text).split()
    for word, n in Counter(words).items():
        out[f" {word} "] += n
        for k in PREFIXES:
            if k > len(word):
                break
            out[" " + word[:k]] += n
    return out, len(words)


def _tally(labelled: DataFrame) -> DataFrame:
    """(entry, toxic, clean, dense_toxic, dense_clean): labelled texts of either kind that have it, or have it densely."""
    names = ["toxic", "clean", "dense_toxic", "dense_clean"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            rows = iter(seen.items())
            while part := list(islice(rows, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.string()), *(pa.array(x, pa.int64()) for x in zip(*(v for _, v in part), strict=True))], names=["entry", *names])
            seen.clear()

        for part in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found, words = _candidates(text or "")
                for entry, n in found.items():
                    row = seen.get(entry)
                    if row is None:
                        row = seen[entry] = [0, 0, 0, 0]
                    row[1 - label] += 1
                    if n > 1 and n >= LEAST_SHARE * words:
                        row[3 - label] += 1
                if len(seen) > FLUSH_ROWS:
                    yield from out()
        yield from out()

    rows = labelled.select("text", F.col("toxic").cast("int").alias("toxic"))
    return rows.mapInArrow(run, "entry string, " + ", ".join(f"{n} long" for n in names)).groupBy("entry").agg(*(F.sum(n).alias(n) for n in names))


def _gain(toxic, clean, share: float):
    """Log-likelihood gain of an entry's own share of toxic texts over the share among all texts."""
    n = F.greatest(toxic + clean, F.lit(1))
    return toxic * F.log(F.greatest(toxic, F.lit(1e-9)) / n / F.lit(share)) + F.when(clean > 0, clean * F.log(F.greatest(clean, F.lit(1e-9)) / n / F.lit(1 - share))).otherwise(0.0)


def _choose(found: list[tuple[str, float, float, bool]]) -> dict[str, tuple[float, bool]]:
    """Entries from (entry, gain, odds, telling): of nested ones the longest that says about as much as the best."""
    best: dict[str, tuple[float, float, bool]] = {}
    for entry, gain, odds, telling in found:
        if entry not in best or (gain, telling) > (best[entry][0], best[entry][2]):
            best[entry] = (gain, odds, telling)
    chosen: dict[str, tuple[float, bool]] = {}
    by_start: dict[str, list[str]] = {}
    for entry in best:
        by_start.setdefault(entry[:5], []).append(entry)
    for entry in sorted(best, key=lambda e: (-best[e][0], -len(e), e)):
        related = [c for c in chosen if c[:5] == entry[:5] and (c.startswith(entry) or entry.startswith(c))]
        if related:
            continue
        gain = best[entry][0]
        longer = [e for e in by_start[entry[:5]] if e.startswith(entry) and best[e][0] >= 0.95 * gain and best[e][2] == best[entry][2]]
        pick = max(longer, key=lambda e: (len(e), e))
        chosen[pick] = (round(best[pick][1], 6), best[pick][2])
    return chosen


def _learned_exceptions(rows: DataFrame, model: Model) -> tuple[str, ...]:
    """Phrases of two words, one with an entry of the model, that LEAST_CLEAN clean rows (text, toxic) or more hold and no toxic one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            phrases, toxic = [], []
            for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = model.phrases(fold(text or ""))
                phrases += found
                toxic += [label] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(toxic, pa.int64())], names=["phrase", "toxic"])

    if not model.entries:
        return ()
    met = rows.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(run, "phrase string, toxic long")
    kept = met.groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("texts")).filter((F.col("toxic") == 0) & (F.col("texts") >= LEAST_CLEAN))
    return tuple(sorted(r.phrase for r in kept.select("phrase").collect()))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps for a ridge-penalised logistic regression; (coefficients with the intercept last, mean, scale)."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def fit(docs: DataFrame, labels: DataFrame, *, exceptions: tuple[str, ...] | None = None, fit_rows: int = FIT_ROWS) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic), without the rows that are held out.

    At most about fit_rows labels of each kind are used, those with the smallest hashes of their ids; so the
    rows that choose the documents are a bounded table, and only chosen texts move. Of rows that repeat an id the
    smallest text is used. exceptions: phrases that are innocent; None learns them from the same rows.
    """
    known = training_labels(labels)
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 20))
    part = F.lit(False)
    for label, n in counts.items():
        part |= (F.col("toxic") == label) & (draw < F.lit(int((1 << 20) * min(1.0, fit_rows / n))))
    chosen = docs.select("doc_id", "text").join(F.broadcast(known.filter(part)), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = materialize(chosen.repartition(F.xxhash64("doc_id")), "toxic-fit")
    toxic, clean = (rows.filter(F.col("toxic") == k).count() for k in (1, 0))
    if not toxic or not clean:
        odds = math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 9))
        return Model({}, exceptions or (), coefficients=(0.0, 0.0, 0.0, 0.0, odds))
    share = toxic / (toxic + clean)
    kinds = []
    for k, (t, c) in enumerate((("toxic", "clean"), ("dense_toxic", "dense_clean"))):
        odds = F.log((F.col(t) + 0.5) / (toxic + 1.0)) - F.log((F.col(c) + 0.5) / (clean + 1.0))
        kinds.append(F.struct(_gain(F.col(t), F.col(c), share).alias("gain"), odds.alias("odds"), F.lit(k == 0).alias("telling"), F.lit(LEAST_GAIN[k]).alias("least_gain"), F.lit(LEAST_ODDS[k]).alias("least_odds")))
    found = (
        _tally(rows).filter("toxic > 1").select("entry", F.explode(F.array(*kinds)).alias("k")).select("entry", "k.*")
        .filter("gain >= least_gain and odds >= least_odds").orderBy(F.desc("gain"), "entry").select("entry", "gain", "odds", "telling").collect()
    )
    entries = _choose([tuple(r) for r in found])
    if exceptions is None:
        exceptions = _learned_exceptions(rows, Model(entries))
    model = Model(entries, exceptions)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            x = np.array([model.evidence(fold(t or "")) for t in part.column(0).to_pylist()], dtype=float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), part.column(1), part.column(2)], names=["a", "b", "c", "d", "toxic", "doc_id"])

    data = rows.select("text", F.col("toxic").cast("double").alias("toxic"), F.col("doc_id").cast("string").alias("doc_id"))
    x = data.mapInArrow(evidence, "a double, b double, c double, d double, toxic double, doc_id string").toPandas().sort_values(["doc_id", "a", "b", "d"])
    w, mean, scale = _logistic(x[["a", "b", "c", "d"]].to_numpy(), x["toxic"].to_numpy())
    return Model(entries, exceptions, coefficients=tuple(map(float, w)), mean=tuple(map(float, mean)), scale=tuple(map(float, scale)))


def with_scores(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a score column; other columns pass unchanged."""
    position = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = pa.array([model.score(t) for t in part.column(position).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], names=[*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(doc_id) -> F.Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of labels 0 and 1 that are not held out. Contradictory or repeated labels: the largest."""
    fit_for_use = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id")))
    return fit_for_use.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, exceptions: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    model = fit(docs, labels, exceptions=exceptions)
    scored = with_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
