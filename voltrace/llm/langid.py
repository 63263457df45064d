"""Language identification by n-gram filters that hold a bitmask of languages.

Texts are lower-cased; letters stay, every run of other characters becomes one
space. N-grams of 1 to 5 code points that hold a letter and no inner space are
hashed. A language contains an n-gram if it uses it often: at a rate of
LEAST_RATE or more among its n-grams of that length, and at LEAST_PART of the
highest rate of any language or more. One bit-sliced Bloom filter keeps all
languages: each place holds a bitmask, the AND of an n-gram's places says which
languages contain it. Counting the bits by language over a text, taking off what
a filter of that load returns by chance, and dividing by the n-grams gives each
language's share of the text; the largest decides (ties: the first by code
point), and its part of all languages' shares is the score.

Rates are learned from at most about ``fit_rows`` texts of each language, the
ones with the smallest hashes of their ids. As a language has at most
1 / LEAST_RATE n-grams of each length, the filter has at most 2^20 places of one
bit a language, whatever the input.

A text that is null or has no letter is ``und`` with score 0. A text with
letters but without any known n-gram gets the language of most learned rows with
score 0. Without any learned language every text is ``und``. Repeated rows are
predicted each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltrace.runtime import materialize

UNKNOWN = "und"
#: Most texts of each language that the filters are learned from.
FIT_ROWS = 5_000
#: Lengths of n-grams; least rate of one of a length in a language; least part of the highest rate in any language.
LENGTHS, LEAST_RATE, LEAST_PART = (1, 2, 3, 4, 5), 1 / 20_000, 0.2
#: Hash functions of the filter, and places for each n-gram of the largest language at least.
HASHES, PLACES = 4, 8
#: Code points of a text that are hashed at once, and distinct n-grams that a task holds before it passes them on.
BLOCK_CHARS, FLUSH_ROWS = 1 << 17, 1 << 18
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def normalised(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, with one space before, after and for each run of other characters."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    other = ~letters()[points]
    keep = ~(other[1:] & other[:-1])
    return np.where(other, np.uint32(32), points)[np.concatenate(([True], keep))]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def grams(points: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of a normalised text, for each of LENGTHS, by blocks that no n-gram is lost between."""
    most = max(LENGTHS)
    for start in range(0, max(1, len(points) - 1), BLOCK_CHARS):
        part = points[start:start + BLOCK_CHARS + most - 1].astype(np.uint64)
        space = part == 32
        spaces = np.concatenate(([0], np.cumsum(space)))
        rolling = np.zeros(len(part), dtype=np.uint64)
        for n in range(1, most + 1):
            count = min(len(part) - n + 1, BLOCK_CHARS)
            if count <= 0:
                break
            rolling = rolling[:len(part) - n + 1] * np.uint64(0x100000001B3) + part[n - 1:]
            if n in LENGTHS:
                if n <= 2:
                    fit = spaces[n:n + count] - spaces[:count] < n
                else:
                    fit = spaces[n - 1:n - 1 + count] == spaces[1:1 + count]
                yield _mixed(rolling[:count][fit] + np.uint64(n * 0xD6E8FEB86659FD93 % (1 << 64)))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Filter:
    """places[i]: the languages at place i, a bit each, eight to a byte; chance: the share of unknown n-grams that each language seems to contain."""

    languages: tuple[str, ...]
    places: np.ndarray
    chance: np.ndarray
    common: str

    @staticmethod
    def build(members: dict[str, np.ndarray], common: str) -> Filter:
        """From hashes of each language's n-grams; common: the language of most learned rows."""
        names = tuple(sorted(members))
        size = 1 << max(10, (PLACES * max((len(members[x]) for x in names), default=1) - 1).bit_length())
        places = np.zeros((size, -(-len(names) // 8)), dtype=np.uint8)
        chance = np.zeros(len(names))
        for k, name in enumerate(names):
            at = np.unique(np.concatenate(Filter._at(members[name], size)))
            places[at, k // 8] |= np.uint8(1 << k % 8)
            chance[k] = (len(at) / size) ** HASHES
        return Filter(names, places, chance, common)

    @staticmethod
    def _at(hashes: np.ndarray, size: int) -> list[np.ndarray]:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return [((hashes + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64) for k in range(HASHES)]

    def containing(self, hashes: np.ndarray) -> np.ndarray:
        """For each hash the bitmask, in bytes, of the languages that contain it (or seem to)."""
        first, *rest = self._at(hashes, len(self.places))
        found = self.places[first]
        for at in rest:
            found &= self.places[at]
        return found

    def shares(self, points: np.ndarray) -> np.ndarray:
        """Each language's corrected share of the n-grams of a normalised text."""
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1  # popcounts by language: each byte value once
        total, counts = 0, np.zeros(8 * self.places.shape[1])
        for hashes in grams(points):
            total += len(hashes)
            found = self.containing(hashes)
            for k in range(found.shape[1]):
                counts[8 * k:8 * k + 8] += np.bincount(found[:, k], minlength=256) @ bits
        hits = counts[:len(self.languages)] / max(1, total)
        return np.maximum(0.0, (hits - self.chance) / (1 - self.chance))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        shares = self.shares(normalised(text))
        if not shares.any():
            return self.common, 0.0
        k = int(shares.argmax())
        return self.languages[k], float(shares[k] / shares.sum())


def held_out(doc_id) -> F.Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _tally(rows: DataFrame) -> DataFrame:
    """(lang, length, gram, n): occurrences of hashed n-grams in the texts of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, n), parts in seen.items():
                gram, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                times = np.bincount(place, weights=np.concatenate([t for _, t in parts])).astype(np.int64)
                for at in range(0, len(gram), 20_000):
                    g = gram[at:at + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(np.full(len(g), n), pa.int32()), pa.array(g.view(np.int64)), pa.array(times[at:at + 20_000])], names=["lang", "length", "gram", "n"])
            seen.clear()

        held = 0
        for part in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for k, hashes in enumerate(grams(normalised(text))):
                    found = np.unique(hashes, return_counts=True)
                    seen.setdefault((lang, LENGTHS[k % len(LENGTHS)]), []).append(found)
                    held += len(found[0])
                if held > FLUSH_ROWS:
                    yield from out()
                    held = 0
        yield from out()

    return rows.select("text", "lang").mapInArrow(run, "lang string, length int, gram long, n long").groupBy("lang", "length", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, *, fit_rows: int = FIT_ROWS) -> Filter:
    """Filters from the rows (doc_id, text, lang) with a language and a text that are not held out."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return Filter.build({}, UNKNOWN)
    draw = F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(1 << 20))
    most = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int((1 << 20) * min(1.0, fit_rows / n)))))
    found = materialize(_tally(known.filter(draw < most[F.col("lang")])), "language-grams")
    totals = found.groupBy("lang", "length").agg(F.sum("n").alias("total"))  # some rows for each language
    rates = found.join(F.broadcast(totals), ["lang", "length"]).withColumn("rate", F.col("n") / F.col("total")).filter(F.col("rate") >= LEAST_RATE)
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"))
    kept = rates.join(best, "gram").filter(F.col("rate") >= LEAST_PART * F.col("best")).select("lang", "gram").toArrow()
    lang, gram = np.array(kept["lang"].to_pylist(), dtype=object), kept["gram"].to_numpy().view(np.uint64)
    return Filter.build({x: gram[lang == x] for x in counts}, max(sorted(counts), key=counts.__getitem__))


def with_language(docs: DataFrame, model: Filter, *, text_col: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with a column for the language and one for its score; other columns pass unchanged."""
    position = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for part in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            found = [filters.predict(t) for t in part.column(position).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*part.schema.names, name, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())]))


def languages(docs: DataFrame, *, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs."""
    found = with_language(docs.select("doc_id", "text"), fit(docs, fit_rows=fit_rows))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
