"""Embedding near-duplicates: binary codes by iterative quantisation, multi-index Hamming tables, exact reranking.

1. On a bounded sample a rotation of the principal components is learned that
   makes their signs balanced binary codes (iterative quantisation).
2. Each distinct vector's code goes into several tables, keyed by substrings of
   the code under different fixed orders of its bits. Rows of a bucket within
   ``max_bits`` of another (far more than links have, given the equal substring)
   become candidates; the others drop out, so original
   vectors move only for candidates.
3. Candidates meet again with their original vectors, in the same buckets;
   pairs with a cosine of the threshold or more, in double precision, are
   links. A pair is counted in the first table in which it meets. Buckets give
   counts of links per vector and a spanning forest, never pairs.

Equal vectors are one class and are not expanded into pairs. Vectors that are
null, zero, or hold null or non-finite components, or are not of the table's
main length, link with nothing: 0 links, a component of their own. Rows that
repeat an id are rows of their own; null ids are allowed, and are no
component's id if there is another. Other columns are not read.

Substrings are as long as keeps a bucket of evenly spread codes at about
BUCKET_ROWS rows whatever the table's size, and the tables are as many as find
TARGET of the pairs just at the threshold, whose differing bits follow from the
angle (see ``plan``). A pair is a candidate in every table whose substring it
shares, if it is within max_bits, so it is counted once, in the first of them.
``exact=True`` compares all vectors with each other, in blocks: work that grows
with the square of the table, for small tables and for measuring recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrace.llm.cells import connected_components, forest, into_cells, iter_blocks, small_pairs
from voltrace.llm.vectors import main_width, matrix, sample, unit, usable
from voltrace.runtime import materialize

SAMPLE_ROWS, ROUNDS, MAX_BITS = 16_384, 40, 16
#: Cells up to this size are compared together, larger ones each on its own.
SMALL_CELL = 48
#: Rows of a bucket, of evenly spread codes, that substrings aim at; their shortest and longest; share of the pairs at the threshold to find; most tables.
BUCKET_ROWS, SUBSTRINGS, TARGET, MOST_TABLES = 2048, (12, 20), 0.97, 600


def plan(rows: int, width: int, threshold: float, max_bits: int = MAX_BITS, target: float = TARGET) -> tuple[int, int]:
    """(substring bits, tables) for a table of so many rows and codes of width bits.

    A pair at cosine c differs in each bit with probability arccos(c) / pi. Of pairs that differ in d bits a table with
    substrings of s bits finds C(width - d, s) / C(width, s); pairs beyond max_bits are lost, whatever the tables.
    """
    least = max(1, min(SUBSTRINGS[0], width // 5))
    bits = min(max(least, math.ceil(math.log2(max(2, rows) / BUCKET_ROWS))), SUBSTRINGS[1], max(least, 3 * width // 8))
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    share = [math.comb(width, d) * p**d * (1 - p) ** (width - d) for d in range(min(max_bits, width) + 1)]
    found = [math.comb(width - d, bits) / math.comb(width, bits) for d in range(len(share))]
    tables = 1
    while tables < MOST_TABLES and sum(w * (1 - (1 - f) ** tables) for w, f in zip(share, found, strict=True)) < min(target, 0.995 * sum(share)):
        tables += 1
    return bits, tables


@dataclass(frozen=True)
class Codes:
    """mean and rotation give the bits; tables are the bit positions of each substring."""

    mean: np.ndarray
    rotation: np.ndarray
    tables: tuple[tuple[int, ...], ...]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes of unit rows, as unsigned longs."""
        bits = (x - self.mean) @ self.rotation > 0
        return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """A column for each table: its number and the code's substring."""
        out = np.empty((len(codes), len(self.tables)), dtype=np.int64)
        for t, positions in enumerate(self.tables):
            sub = np.zeros(len(codes), dtype=np.uint64)
            for k, p in enumerate(positions):
                sub |= ((codes >> np.uint64(p)) & np.uint64(1)) << np.uint64(k)
            out[:, t] = (t << 32) | sub.astype(np.int64)
        return out


def learn(x: np.ndarray, *, max_bits: int = 64, rounds: int = ROUNDS, rows: int | None = None, threshold: float = 0.9, seed: int = 42) -> Codes:
    """Iterative quantisation on unit rows, a sample of ``rows``: principal components, then alternate signs and the rotation nearest to them."""
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0)
    width = min(max_bits, x.shape[1])
    _, vectors = np.linalg.eigh(np.cov((x - mean).T).reshape(x.shape[1], x.shape[1]) if len(x) > 1 else np.eye(x.shape[1]))
    components = vectors[:, ::-1][:, :width]
    v = (x - mean) @ components
    rotation, _ = np.linalg.qr(rng.normal(size=(width, width)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(v @ rotation).T @ v)
        rotation = (u @ w).T
    bits, n_tables = plan(rows or len(x), width, threshold)
    tables: list[tuple[int, ...]] = []
    while len(tables) < n_tables:  # disjoint substrings of one order of the bits after another
        order = np.random.default_rng(seed + len(tables)).permutation(width)
        tables += [tuple(map(int, order[at:at + bits])) for at in range(0, width - bits + 1, bits)]
    return Codes(mean, components @ rotation, tuple(tables[:n_tables]))


def _distinct(rows: DataFrame) -> DataFrame:
    """(cid, vector, copies, first): distinct usable vectors of the main length."""
    good = rows.filter(usable(F.col("vector")))
    good = good.filter(F.size("vector") == main_width(good, "vector"))
    found = good.groupBy("vector").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"))
    return materialize(found.select(F.monotonically_increasing_id().alias("cid"), "vector", "copies", "first"), "itq-distinct")


def _candidates(distinct: DataFrame, codes: Codes, max_bits: int, cell_rows: int) -> DataFrame:
    """(key, cid, code) of vectors that have another within max_bits in that bucket."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                made = codes.encode(unit(matrix(part.column(1))))
                keys = codes.keys(made)
                n = keys.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), n)), pa.array(np.repeat(made.view(np.int64), n))], names=["key", "cid", "code"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in iter_blocks(batches, "key"):
            code, own, across = cols["code"].view(np.uint64), cols["own"], cols["cell_i"] != cols["cell_j"]
            hit = np.zeros(len(code), dtype=bool)
            i, j = small_pairs(starts, SMALL_CELL)
            ok = (np.bitwise_count(code[i] ^ code[j]) <= max_bits) & (~across[i] | (own[i] != own[j]))
            hit[i[ok]] = hit[j[ok]] = True
            for k in np.flatnonzero(np.diff(starts) > SMALL_CELL):
                a, b = starts[k], starts[k + 1]
                for at in range(a, b, 256):
                    to = min(at + 256, b)
                    close = np.bitwise_count(code[at:to, None] ^ code[None, a:b]) <= max_bits
                    close[np.arange(to - at), np.arange(at - a, to - a)] = False
                    if across[a]:
                        close &= own[at:to, None] != own[None, a:b]
                    hit[at:to] = close.any(axis=1)
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(cols["key"][hit]), pa.array(cols["cid"][hit]), pa.array(cols["code"][hit])], names=["key", "cid", "code"])

    rows = distinct.select("cid", "vector").mapInArrow(keyed, "key long, cid long, code long")
    return into_cells(rows, "key", "cid", cell_rows).mapInArrow(near, "key long, cid long, code long").distinct()


def _links(candidates: DataFrame, distinct: DataFrame, codes: Codes, threshold: float, max_bits: int | None, cell_rows: int) -> DataFrame:
    """Rows (cid, root, n): the vectors linked directly to cid in a cell (n, copies counted), and cid's root in the cell's forest.

    Pairs count within max_bits, in their first table; with max_bits None there is one table and all pairs count.
    """

    def linked(x: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        i, j = small_pairs(starts, SMALL_CELL)
        for at in range(0, len(i), 1 << 15):
            a, b = i[at:at + (1 << 15)], j[at:at + (1 << 15)]
            ok = np.einsum("nd,nd->n", x[a], x[b]) >= threshold
            yield a[ok], b[ok]
        for k in np.flatnonzero(np.diff(starts) > SMALL_CELL):
            first, end = starts[k], starts[k + 1]
            for at in range(first, end, 256):
                a, b = np.nonzero(x[at:min(at + 256, end)] @ x[at:end].T >= threshold)
                ok = a < b
                yield a[ok] + at, b[ok] + at

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in iter_blocks(batches, "key"):
            x, code = unit(cols["vector"].astype(np.float64)), cols["code"].view(np.uint64)
            keys = codes.keys(code)
            cid, copies, own, across, table = cols["cid"], cols["copies"], cols["own"], cols["cell_i"] != cols["cell_j"], cols["key"] >> 32
            n, before = len(cid), np.arange(keys.shape[1])
            count, label = np.zeros(n, dtype=np.int64), np.arange(n)
            for i, j in linked(x, starts):
                ok = ~across[i] | (own[i] != own[j])
                i, j = i[ok], j[ok]
                if max_bits is not None:  # within max_bits both are candidates in every table whose substring they share; this is the first
                    ok = np.bitwise_count(code[i] ^ code[j]) <= max_bits
                    i, j = i[ok], j[ok]
                    ok = ~((keys[i] == keys[j]) & (before[None] < table[i][:, None])).any(axis=1)
                    i, j = i[ok], j[ok]
                if len(i):
                    np.add.at(count, i, copies[j])
                    np.add.at(count, j, copies[i])
                    nodes = np.arange(n)
                    label = forest(n, np.concatenate([nodes, i]), np.concatenate([label, j]))
            hit = np.flatnonzero(count)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(cid[hit]), pa.array(cid[label[hit]]), pa.array(count[hit])], names=["cid", "root", "n"])

    rows = candidates.join(distinct.select("cid", "vector", "copies"), "cid")
    return into_cells(rows, "key", "cid", cell_rows).mapInArrow(verify, "cid long, root long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, *, id_col: str = "vec_id", vector_col: str = "embedding", max_bits: int = MAX_BITS, cell_rows: int = 4096,
                    exact: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row. exact: all pairs are compared, without codes."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    distinct = _distinct(rows)
    total = distinct.count()
    single = F.col("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    if not total:
        return rows.select(*single)
    codes = learn(unit(sample(distinct, "vector", "vector", SAMPLE_ROWS, total)), rows=total, threshold=threshold)
    if exact:
        everything = distinct.select(F.lit(0).cast("long").alias("key"), "cid", F.lit(0).cast("long").alias("code"))
        found = materialize(_links(everything, distinct, codes, threshold, None, cell_rows), "itq-links")
    else:
        candidates = materialize(_candidates(distinct, codes, max_bits, cell_rows), "itq-candidates")
        found = materialize(_links(candidates, distinct, codes, threshold, max_bits, cell_rows), "itq-links")
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    groups = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), "itq")
    known = (
        distinct.join(counts, "cid", "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left")
        .select("vector", "first", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    )
    known = materialize(known, "itq-known")
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = known.join(least, "component").select(F.col("vector").alias("class_vector"), "n_links", "component_id")
    # Rows that take no part go around the join: their vectors would be one hot key.
    part = usable(F.col("vector"))
    joined = rows.filter(part).join(classes, F.col("vector") == F.col("class_vector"), "left")
    n_links, component = F.coalesce("n_links", F.lit(0)).cast("long"), F.coalesce("component_id", "vec_id")
    joined = joined.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
    return joined.unionByName(rows.filter(~part).select(*single))
