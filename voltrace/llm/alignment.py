"""Cross-tokenizer alignment by sparse products of token-byte incidence matrices.

Both tokenizers cut the same bytes (a space, then the text). A row of matrix A
is a token of the first, a column a byte; B likewise. Gustavson's row products
A Bᵀ give the overlap links: pairs of tokens that share bytes, with how many.
Links whose tokens end together (end links) mark the places where both cuts
agree; these places part the tokens into groups, and the products of the
token-group incidence matrices give the shared-group links. Matrices are CSR,
built here from token lengths; those of many documents are the blocks of one
block-diagonal matrix, and products go by blocks of rows, so memory is bounded
by the tokens of one document plus a constant.

Documents are encoded once; what later steps need (id pairs of end links with
their numbers) is written to the shared folder. An id pair's count over the
corpus is an aggregate with partial sums. A head of at most ``head_pairs``
frequent pairs, a bounded dictionary, is broadcast and summed where documents
are read; the other pairs are joined by a shuffle on the pair.

Null and empty texts, and texts whose token bytes differ from the space and the
text (a U+2581 in it, for example), have no tokens: zeros and an empty digest.
Repeated rows give a result each and count each; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltrace.llm.packing import LONG_SPACE, TextEncoder
from voltrace.llm.units import units
from voltrace.runtime import materialize

#: Pairs that are broadcast; bytes of text whose matrices are built at once; products expanded at once.
HEAD_PAIRS, BLOCK_BYTES, BLOCK_PRODUCTS = 1 << 19, 1 << 17, 1 << 18
CACHE_UNITS = 400_000  # units whose ids a worker keeps
SPACE = "▁"  # how pieces write a space


@dataclass(frozen=True)
class Csr:
    """Row i has columns indices[indptr[i]:indptr[i + 1]] and the values of data there."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def transpose(self, columns: int) -> Csr:
        row = np.repeat(np.arange(self.rows), np.diff(self.indptr))
        order = np.argsort(self.indices, kind="stable")
        indptr = np.concatenate(([0], np.cumsum(np.bincount(self.indices, minlength=columns))))
        return Csr(indptr, row[order], self.data[order])


def gustavson(a: Csr, b: Csr, columns: int, block: int = BLOCK_PRODUCTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, value) arrays of the product of a and b, by blocks of whole rows with about ``block`` products at most (more only for one row)."""
    sizes = np.diff(b.indptr)[a.indices]  # a row's product joins these many entries for each entry
    done = np.concatenate(([0], np.cumsum(sizes)))[a.indptr]
    start = 0
    while start < a.rows:
        stop = max(start + 1, int(np.searchsorted(done, done[start] + block, side="right")) - 1)
        lo, hi = a.indptr[start], a.indptr[stop]
        n = sizes[lo:hi]
        row = np.repeat(np.repeat(np.arange(start, stop), np.diff(a.indptr[start:stop + 1])), n)
        at = np.arange(len(row)) + np.repeat(b.indptr[a.indices[lo:hi]] - (np.cumsum(n) - n), n)
        column, value = b.indices[at], np.repeat(a.data[lo:hi], n) * b.data[at]
        key = row * columns + column
        if np.any(key[1:] < key[:-1]):
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
        if len(first):
            yield key[first] // columns, key[first] % columns, np.add.reduceat(value, first)
        start = stop


def incidence(ends: np.ndarray) -> Csr:
    """Tokens by bytes, from where each token ends."""
    total = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate(([0], ends)), np.arange(total), np.ones(total, dtype=np.int64))


def membership(group: np.ndarray) -> Csr:
    """Tokens by groups, from each token's group."""
    return Csr(np.arange(len(group) + 1), group, np.ones(len(group), dtype=np.int64))


@dataclass(frozen=True)
class Alignment:
    """Overlap links (a, b, bytes) of tokens by position, which of them end together, and the groups of both sides' tokens."""

    a: np.ndarray
    b: np.ndarray
    shared: np.ndarray
    ends: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray

    def group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(a, b) of tokens in one group, by blocks."""
        groups = int(self.group_a[-1]) + 1 if len(self.group_a) else 0
        for a, b, _ in gustavson(membership(self.group_a), membership(self.group_b).transpose(groups), max(1, len(self.group_b))):
            yield a, b


def align(lengths_a: np.ndarray, lengths_b: np.ndarray) -> Alignment:
    """Aligns two cuts of the same bytes, given the byte lengths of their tokens (all positive, with equal sums)."""
    end_a, end_b = np.cumsum(lengths_a, dtype=np.int64), np.cumsum(lengths_b, dtype=np.int64)
    total = int(end_a[-1]) if len(end_a) else 0
    parts = list(gustavson(incidence(end_a), incidence(end_b).transpose(total), max(1, len(end_b))))
    a, b, shared = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=np.int64),) * 3
    ends = end_a[a] == end_b[b]
    common = end_a[a[ends]]
    return Alignment(a, b, shared, ends, np.searchsorted(common, end_a), np.searchsorted(common, end_b))


class Side:
    """A tokenizer: ids of a space and the text, without special tokens, and the bytes of each id.

    by_units: both kinds encode the units of voltrace.llm.units one by one as they do the text: the byte-level BPE by its pre-tokens, pieces if a space stands
    only at their start (so no merge joins what comes before a space to it).
    """

    def __init__(self, path: str) -> None:
        if path.endswith(".json"):
            made = TextEncoder(path)
            size = made.bpe.n_vocab
            self.bytes = [b""] * size
            for i in {*range(size)} - {*made.bpe._special_tokens.values()}:
                self.bytes[i] = made.bpe.decode_single_token_bytes(i)
            self.ids: Callable[[str], list[int]] = lambda text: made.bpe.encode_ordinary(text) if len(text) < LONG_SPACE else made.ids(text, special=False).tolist()
            self.by_units = True
        elif path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
            self.bytes = [bytes([int(p[3:-1], 16)]) if pieces.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
            self.ids = lambda text: pieces.encode(text[1:], num_threads=1)  # it adds the space itself
            self.by_units = not any(SPACE in p.lstrip(SPACE) for p in names)
        else:
            raise ValueError(f"no library for {path}")
        self.lengths = np.array([len(x) for x in self.bytes], dtype=np.int64)
        width = len(str(len(self.bytes)))
        names = [str(i).encode() for i in range(len(self.bytes))]
        #: Decimal digits of each id, with room for a sign after them.
        self.digits = np.frombuffer(b"".join(x.ljust(width + 1) for x in names), dtype=np.uint8).reshape(-1, width + 1)
        self.n_digits = np.array([len(x) for x in names])

    def encode(self, text: str) -> bytes | None:
        """Ids, as little-endian 32-bit integers, of a text that starts with a space, if their bytes in order are the text's."""
        ids = self.ids(text)
        return np.array(ids, dtype="<u4").tobytes() if b"".join([self.bytes[i] for i in ids]) == text.encode() else None


class Encoder:
    """Ids of both sides for a text, unit by unit with a bounded cache, or of the whole text where a side's units depend on each other."""

    def __init__(self, a: Side, b: Side) -> None:
        self.a, self.b, self.cache = a, b, {}

    def unit(self, text: str) -> tuple[bytes, bytes] | None:
        ids_a = self.a.encode(text)
        ids_b = None if ids_a is None else self.b.encode(text)
        made = None if ids_b is None else (ids_a, ids_b)
        if len(self.cache) < CACHE_UNITS and len(text) < 64:
            self.cache[text] = made
        return made

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """None for no text, and for one whose token bytes would be others. A sign that pieces take for a space has other bytes, and its neighbours may merge with it."""
        if not text or SPACE in text:
            return None
        cache, missing, found = self.cache, object(), []
        # The first unit may start with more than one space; all others start with exactly one.
        head, *rest = units(text) if text[0] != " " else [text]
        for u in [" " + head, *rest] if self.a.by_units and self.b.by_units else [" " + text]:
            pair = cache.get(u, missing)
            if pair is missing:
                pair = self.unit(u)
            if pair is None:
                return None
            found.append(pair)
        return tuple(np.frombuffer(b"".join([p[k] for p in found]), dtype="<u4").astype(np.int64) for k in (0, 1))


_SIDES: dict[str, Side] = {}
_BOTH: dict[tuple[str, str], Encoder] = {}


def side(path: str) -> Side:
    if path not in _SIDES:
        _SIDES[path] = Side(path)
    return _SIDES[path]


def encoder(path_a: str, path_b: str) -> Encoder:
    if (path_a, path_b) not in _BOTH:
        _BOTH[path_a, path_b] = Encoder(side(path_a), side(path_b))
    return _BOTH[path_a, path_b]


def group_texts(a: Side, b: Side, ids_a: np.ndarray, ids_b: np.ndarray, found: Alignment, groups: np.ndarray) -> list[bytes]:
    """For each document, given the first group of each and the end, its groups as ``a1,a2|b1;a3|b2,b3``."""
    ga, gb, n = found.group_a, found.group_b, len(ids_a) + len(ids_b)
    width = max(a.digits.shape[1], b.digits.shape[1])
    chars, size = np.zeros((n, width), dtype=np.uint8), np.zeros(n, dtype=np.int64)
    place_a = np.arange(len(ids_a)) + np.searchsorted(gb, ga)  # after the other side's tokens of earlier groups
    place_b = np.arange(len(ids_b)) + np.searchsorted(ga, gb, side="right")
    for which, ids, place, group, last in ((a, ids_a, place_a, ga, b"|"), (b, ids_b, place_b, gb, b";")):
        chars[place, :which.digits.shape[1]] = which.digits[ids]
        size[place] = which.n_digits[ids]
        final = np.concatenate((group[1:] != group[:-1], [True]))[:len(group)]
        chars[place, which.n_digits[ids]] = np.where(final, last[0], ord(","))
    flat = chars[np.arange(width) <= size[:, None]].tobytes()
    ends = np.concatenate(([0], np.cumsum(size + 1)))
    first = np.searchsorted(ga, groups) + np.searchsorted(gb, groups)
    return [flat[ends[i]:max(ends[i], ends[j] - 1)] for i, j in zip(first, first[1:], strict=False)]


@dataclass(frozen=True)
class _Block:
    """Documents in a row with their encodings; those without tokens have none in ids and zero in the counts."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    found: Alignment


def _blocks(batches: Iterator[pa.RecordBatch], column: int, path_a: str, path_b: str) -> Iterator[tuple[pa.RecordBatch, _Block]]:
    a, b, encode = side(path_a), side(path_b), encoder(path_a, path_b)
    none = np.zeros(0, dtype=np.int64)
    for batch in batches:
        texts, start = batch.column(column), 0
        while start < batch.num_rows:
            held, stop, found_a, found_b = 0, start, [], []
            while stop < batch.num_rows and held < BLOCK_BYTES:
                text = texts[stop].as_py()
                ids_a, ids_b = encode(text) or (none, none)
                found_a.append(ids_a)
                found_b.append(ids_b)
                held, stop = held + len(text or ""), stop + 1
            ids_a, ids_b = np.concatenate(found_a), np.concatenate(found_b)
            n_a, n_b = (np.array([len(x) for x in found]) for found in (found_a, found_b))
            yield batch.slice(start, stop - start), _Block(ids_a, ids_b, n_a, n_b, align(a.lengths[ids_a], b.lengths[ids_b]))
            start = stop


def token_links(docs: DataFrame, path_a: str, path_b: str, kind: str = "overlap", *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a, b, id_a, id_b, n_bytes): links of tokens by position in their document.

    kind: overlap (tokens that share bytes; n_bytes says how many), end (those that end together), or group (tokens in a group; n_bytes is null).
    """
    if kind not in ("overlap", "end", "group"):
        raise ValueError(f"unknown kind of links: {kind}")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in _blocks(batches, 1, path_a, path_b):
            first_a, first_b = (np.concatenate(([0], np.cumsum(n))) for n in (block.n_a, block.n_b))
            found = block.found
            links = ((a, b, None) for a, b in found.group_links()) if kind == "group" else iter([tuple(x if kind == "overlap" else x[found.ends] for x in (found.a, found.b, found.shared))])
            for a, b, shared in links:
                doc = np.searchsorted(first_a, a, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc)), *map(pa.array, (a - first_a[doc], b - first_b[doc], block.ids_a[a], block.ids_b[b])),
                     pa.nulls(len(a), pa.int64()) if shared is None else pa.array(shared)], names=["doc_id", "a", "b", "id_a", "id_b", "n_bytes"])

    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in ("a", "b", "id_a", "id_b", "n_bytes"))])
    return rows.mapInArrow(run, schema)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_shared")


def _encoded(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, counts.., groups_sha256, pair_a, pair_b, pair_n): a row for each document, with its distinct id pairs of end links."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = side(path_a), side(path_b)
        for part, block in _blocks(batches, 1, path_a, path_b):
            found, n = block.found, part.num_rows
            first_a = np.concatenate(([0], np.cumsum(block.n_a)))
            doc_of_a = np.repeat(np.arange(n), block.n_a)
            ending = found.a[found.ends]
            groups = np.searchsorted(ending, first_a)  # each end link closes one group, in order
            texts = group_texts(a, b, block.ids_a, block.ids_b, found, groups)
            in_group = np.bincount(found.group_b, minlength=len(ending))  # products of a row, without expanding them
            shared = np.bincount(doc_of_a, weights=in_group[found.group_a], minlength=n).astype(np.int64) if len(doc_of_a) else np.zeros(n, dtype=np.int64)
            counts = [block.n_a, block.n_b, np.diff(groups), np.bincount(doc_of_a[ending], minlength=n), np.bincount(doc_of_a[found.a], minlength=n), shared]
            ids_b = len(b.bytes)
            key, times = np.unique((doc_of_a[ending] * len(a.bytes) + block.ids_a[ending]) * ids_b + block.ids_b[found.b[found.ends]], return_counts=True)
            cut = pa.array(np.concatenate(([0], np.cumsum(np.bincount(key // (len(a.bytes) * ids_b), minlength=n)))), pa.int32())
            pairs = [key // ids_b % len(a.bytes), key % ids_b, times]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(x, pa.int64()) for x in counts), pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts], pa.string()),
                 *(pa.ListArray.from_arrays(cut, pa.array(x, pa.int32())) for x in pairs)], names=["doc_id", *_COUNTS, "groups_sha256", "pair_a", "pair_b", "pair_n"])

    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in _COUNTS), T.StructField("groups_sha256", T.StringType()),
                           *(T.StructField(x, T.ArrayType(T.IntegerType())) for x in ("pair_a", "pair_b", "pair_n"))])
    return rows.mapInArrow(run, schema)


def _pairs(encoded: DataFrame) -> DataFrame:
    """(id_a, id_b, count, best): how many end links hold an id pair over the corpus, and whether no pair of its id_b has more."""
    each = encoded.select(F.explode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("p"))
    counts = materialize(each.groupBy(F.col("p.pair_a").alias("id_a"), F.col("p.pair_b").alias("id_b")).agg(F.sum("p.pair_n").alias("count")), "align-pairs")
    most = counts.groupBy("id_b").agg(F.max("count").alias("most"))  # a row for each id of a vocabulary
    return counts.join(most, "id_b").select("id_a", "id_b", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps, n_shared) of every row.

    n_links are end links; n_best those whose id pair is their B id's most frequent one over the corpus (ties included), count_sum the sum of their
    pairs' counts. n_overlaps and n_shared are the numbers of overlap links and of shared-group links.
    """
    encoded = materialize(_encoded(docs, path_a, path_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "align-encoded")
    pairs = materialize(_pairs(encoded), "align-counted")
    # The head: all pairs above the lowest frequency step that leaves at most head_pairs.
    step = F.floor(F.log2("count") * 16)
    steps = pairs.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect()  # at most 16 * 64 rows
    least = min((s.step for s, n in zip(steps, accumulate(s.n for s in steps), strict=True) if n <= head_pairs), default=1 << 20)
    top = pairs.filter(step >= least).select(F.shiftleft(F.col("id_a").cast("long"), 32).bitwiseOR(F.col("id_b").cast("long")).alias("key"), "count", "best").orderBy("key").toArrow()
    head = docs.sparkSession.sparkContext.broadcast(tuple(top[x].to_numpy() for x in ("key", "count", "best")))
    del top

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each document a row with its sums over the head (id_a null), and a row for each other pair."""
        keys, count, best = head.value
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            row = batch.column(0).to_numpy()
            id_a, id_b, n = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (1, 2, 3))
            doc = np.repeat(np.arange(len(row)), batch.column(1).value_lengths().to_numpy())
            key = id_a << 32 | id_b
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            hit = keys[at] == key if len(keys) else np.zeros(len(key), dtype=bool)
            sums = [np.zeros(len(row), dtype=np.int64) for _ in range(2)]
            np.add.at(sums[0], doc[hit], n[hit] * best[at[hit]])
            np.add.at(sums[1], doc[hit], n[hit] * count[at[hit]])
            blank, rest = np.full(len(row), -1), ~hit
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x), pa.int64()) for x in ((row, row[doc[rest]]), (blank, id_a[rest]), (blank, id_b[rest]), (blank, n[rest]))]
                + [pa.array(np.concatenate((x, np.zeros(int(rest.sum()), dtype=np.int64))), pa.int64()) for x in sums],
                names=["row", "id_a", "id_b", "n", "n_best", "count_sum"])

    parts = encoded.select("row", "pair_a", "pair_b", "pair_n").mapInArrow(known, "row long, id_a long, id_b long, n long, n_best long, count_sum long")
    # Sums over the head match no pair; the row's number spreads them over the join's tasks.
    joined = parts.withColumn("id_b", F.when(F.col("n") < 0, -1 - F.col("row")).otherwise(F.col("id_b"))).join(
        pairs.select(F.col("id_a").cast("long").alias("id_a"), F.col("id_b").cast("long").alias("id_b"), "count", "best"), ["id_a", "id_b"], "left")
    sums = joined.groupBy("row").agg(
        F.sum(F.coalesce(F.col("n") * F.col("best").cast("long"), "n_best")).alias("n_best"), F.sum(F.coalesce(F.col("n") * F.col("count"), "count_sum")).alias("count_sum"))
    return encoded.drop("pair_a", "pair_b", "pair_n").join(sums, "row").select("doc_id", *_COUNTS[:4], "n_best", "count_sum", "groups_sha256", *_COUNTS[4:])
