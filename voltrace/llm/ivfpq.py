"""Nearest neighbours by cosine: inverted file, product-quantised residuals, exact reranking of all that bounds leave.

Fitting, on a bounded sample: coarse centroids by k-means of unit vectors, and
codebooks of the residuals' sub-vectors. The number of lists follows from the
table's rows (``lists_for``). Indexing covers every usable row: its nearest
centroid's list, its code, and two lengths, of its residual and of what the
code leaves of it. A list is cut into blocks by a hash, so a list with a third
of all rows is many tasks' work and a block fits a task.

Each query goes twice to blocks. First to those of its nearest lists, until
these hold ``first_rows`` rows: asymmetric distances from a table per list and
query rank the block's codes, and the best (``rerank``, or a share of a small
block) are scored with the original vectors, in double precision. Then, with
the k-th best score so far, to those of every other list that may hold a better
one: not where the triangle inequality with the list's shortest and longest
residual, or the plane between its centroid and the query's nearest one, rules
that out.

In either, a row is left out only if its distance is provably too large: at
least the asymmetric one less what the code leaves, and at least the difference
of the residuals' lengths. All other rows are scored, so the answers are the
nearest whatever the sample, the codebooks or the table's width. The sample
decides only how much is ruled out: much where vectors have structure, little
where neighbours are hardly nearer than others.

Equal vectors are one entry with the smallest ids that can matter, so copies
never crowd a block. Vectors that are null, zero, or hold null or non-finite
components, or are not of the table's main length, take no part. Null ids take
no part either. Rows that repeat an id count as one candidate, by the nearest of
its vectors; as a query such an id asks with its smallest vector. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltrace.llm.vectors import main_width, matrix, sample, unit, usable
from voltrace.runtime import materialize

SAMPLE_ROWS, MAX_LISTS, SUBVECTORS, CODEWORDS, ITERATIONS = 20_000, 1024, 16, 64, 8
#: LEAST_RERANK and LEAST_SHARE: what is reranked of a small block before bounds are applied.
BLOCK_ROWS, RERANK, LEAST_RERANK, LEAST_SHARE, FIRST_ROWS = 4096, 300, 24, 0.5, 1024
#: Rounding: of scores and bounds of scores, of distances to centroids, and the share of an asymmetric distance.
SLACK, SLACK_FAR, SLACK_SHARE = 1e-12, 1e-7, 1e-5
#: Below every cosine: the k-th best score of a query with fewer candidates so far.
NONE = -2.0


def lists_for(rows: int) -> int:
    """Half the root of the rows, at most MAX_LISTS: a list then holds twice as many rows as there are lists, and more only in tables of over four million rows, in blocks."""
    return int(max(1, min(MAX_LISTS, round(rows**0.5 / 2))))


def reranked(rows: int, rerank: int) -> int:
    """How many of a block's rows are scored before bounds are applied, those with the smallest asymmetric distances."""
    return min(rows, rerank, max(LEAST_RERANK, math.ceil(LEAST_SHARE * rows)))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, iterations: int = ITERATIONS) -> np.ndarray:
    centres = x[rng.choice(len(x), size=k, replace=False)].copy()
    for _ in range(iterations):
        nearest = _nearest(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        n = np.bincount(nearest, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        centres[n == 0] = x[rng.choice(len(x), size=int((n == 0).sum()))]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n nearest centres of each row, nearest first."""
    out = np.empty((len(x), n), dtype=np.int64)
    norms = (centres * centres).sum(axis=1)
    for at in range(0, len(x), 1024):
        d = norms - 2 * x[at:at + 1024] @ centres.T
        out[at:at + 1024] = d.argmin(axis=1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n]
    return out


def _filled(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


@dataclass(frozen=True)
class Index:
    """coarse: centroids; books: (sub-vector, codeword, component), the last sub-vector filled with zeros."""

    coarse: np.ndarray
    books: np.ndarray

    def encode(self, residuals: np.ndarray) -> np.ndarray:
        m, _, w = self.books.shape
        residuals = _filled(residuals, m * w)
        return np.stack([_nearest(residuals[:, k * w:(k + 1) * w], self.books[k], 1)[:, 0] for k in range(m)], axis=1).astype(np.uint8)

    def left(self, residuals: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Lengths of what the codes leave of the residuals."""
        m, _, w = self.books.shape
        residuals = _filled(residuals, m * w)
        return np.sqrt(sum(((residuals[:, k * w:(k + 1) * w] - self.books[k][codes[:, k]]) ** 2).sum(axis=1) for k in range(m)))

    def distances(self, residuals: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of queries' residuals to codes: sums of table entries."""
        m, _, w = self.books.shape
        residuals = _filled(residuals, m * w)
        out = np.zeros((len(residuals), len(codes)), dtype=np.float32)
        for k in range(m):
            part = residuals[:, None, k * w:(k + 1) * w] - self.books[k][None]
            out += (part * part).sum(axis=2).astype(np.float32)[:, codes[:, k]]
        return out


def fit(x: np.ndarray, *, lists: int | None = None, subvectors: int = SUBVECTORS, codewords: int = CODEWORDS, seed: int = 42) -> Index:
    """An index structure from unit rows x."""
    rng = np.random.default_rng(seed)
    coarse = _kmeans(x, min(len(x), lists or lists_for(len(x))), rng)
    w = -(-x.shape[1] // min(subvectors, x.shape[1]))
    m = -(-x.shape[1] // w)
    residuals = _filled(x - coarse[_nearest(x, coarse, 1)[:, 0]], m * w)
    return Index(coarse, np.stack([_kmeans(residuals[:, j * w:(j + 1) * w], min(codewords, len(x)), rng) for j in range(m)]))


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """(eid, vector, ids): distinct usable vectors, with their k + 1 smallest ids in order."""
    good = rows.filter(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    good = good.filter(F.size("vector") == main_width(good, "vector"))
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = good.dropDuplicates(["vec_id", "vector"]).withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    # At most k + 1 rows of each vector are gathered.
    found = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return materialize(found.select(F.monotonically_increasing_id().alias("eid"), "vector", "ids"), "ann-entries")


def _indexed(entries: DataFrame, index: Index) -> DataFrame:
    """(list, code, radius, remainder, vector, ids) of every entry; radius and remainder are the lengths of its residual and of what its code leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = unit(matrix(part.column(0)))
                own = _nearest(x, index.coarse, 1)[:, 0]
                residuals = x - index.coarse[own]
                codes = index.encode(residuals)
                columns = [pa.array(own), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.sqrt((residuals * residuals).sum(axis=1))), pa.array(index.left(residuals, codes)), part.column(0), part.column(1)]
                yield pa.RecordBatch.from_arrays(columns, names=["list", "code", "radius", "remainder", "vector", "ids"])

    kind = entries.schema["vector"].dataType.simpleString()
    ids = entries.schema["ids"].dataType.simpleString()
    return entries.select("vector", "ids").mapInArrow(run, f"list long, code binary, radius double, remainder double, vector {kind}, ids {ids}")


def _best(ids: list[list[int]], rows: np.ndarray, scores: np.ndarray, query: int, k: int) -> list[tuple[int, float]]:
    """The k best (id, score) other than the query, ties to smaller ids, of block rows (in the order of their first ids) and their scores."""
    found: dict[int, float] = {}
    firsts = set()
    for c in np.lexsort((rows, -scores)):
        of = ids[rows[c]]
        for i in of:
            if i != query:
                found.setdefault(i, float(scores[c]))
        if of[0] != query:
            firsts.add(of[0])
            if len(firsts) == k:  # each is before all ids of later rows
                break
    return sorted(found.items(), key=lambda f: (-f[1], f[0]))[:k]


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of unit rows with unit q, the same whatever other rows are asked with them."""
    return (x * q).sum(axis=1)


@dataclass(frozen=True)
class Block:
    """A block's entries, in the order of their first ids."""

    codes: np.ndarray
    radius: np.ndarray
    remainder: np.ndarray
    x: np.ndarray
    ids: list[list[int]]

    @classmethod
    def of(cls, batches: list[pa.RecordBatch]) -> Block:
        held = pa.Table.from_batches(batches)
        first = np.array([i[0] for i in held["ids"].to_pylist()])
        held = held.take(pa.array(np.argsort(first, kind="stable")))
        codes = np.frombuffer(b"".join(held["code"].to_pylist()), dtype=np.uint8).reshape(held.num_rows, -1)
        return cls(codes, held["radius"].to_numpy(), held["remainder"].to_numpy(), unit(matrix(held["vector"].combine_chunks())), held["ids"].to_pylist())

    def answers(self, index: Index, centre: np.ndarray, q: np.ndarray, names: list[int], limit: np.ndarray, k: int, rerank: int) -> Iterator[tuple[int, int, float]]:
        """(query_id, vec_id, score) of the k best of each query here that are not worse than its limit."""
        residuals = q - centre
        far = np.sqrt(index.distances(residuals, self.codes))
        limit = limit.copy()
        for row in np.flatnonzero(limit == NONE):
            n = reranked(len(self.ids), rerank)
            seeds = np.argpartition(far[row], n - 1)[:n]
            best = _best(self.ids, seeds, _scores(self.x[seeds], q[row]), names[row], k)
            if len(best) == k:
                limit[row] = best[-1][1]
        reach = np.sqrt((residuals * residuals).sum(axis=1))[:, None]
        least = np.maximum(far * (1 - SLACK_SHARE) - self.remainder, np.abs(reach - self.radius))  # of the distances
        kept = 1 - np.maximum(least, 0) ** 2 / 2 >= limit[:, None] - SLACK
        rows = np.flatnonzero(kept.any(axis=0))
        good = kept[:, rows] & (q @ self.x[rows].T >= limit[:, None] - SLACK)
        for row in np.flatnonzero(good.any(axis=1)):
            mine = rows[good[row]]
            for i, score in _best(self.ids, mine, _scores(self.x[mine], q[row]), names[row], k):
                yield names[row], i, score


def _search(batches: Iterator[pa.RecordBatch], index: Index, k: int, rerank: int) -> Iterator[pa.RecordBatch]:
    """Answers within blocks, from rows sorted by (list, block, is it a query): each block's rows come before its queries."""
    block, at_block, ready = None, None, None
    for batch in batches:
        lists, blocks, asks = (batch.column(i).to_numpy() for i in range(3))
        change = np.flatnonzero((lists[1:] != lists[:-1]) | (blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1
        for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
            if a == b:
                continue
            part, here = batch.slice(a, b - a), (int(lists[a]), int(blocks[a]))
            if not asks[a]:
                block = [part] if at_block != here else [*block, part]
                at_block, ready = here, None
                continue
            if at_block != here:
                continue  # no rows in this block
            ready = ready or Block.of(block)
            for at in range(0, part.num_rows, 128):
                asked = pa.Table.from_batches([part.slice(at, 128)])
                q = unit(matrix(asked["vector"].combine_chunks()))
                out = list(ready.answers(index, index.coarse[here[0]], q, asked["query_id"].to_pylist(), asked["limit"].to_numpy(), k, rerank))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])


@dataclass(frozen=True)
class Lists:
    """Rows, shortest and longest residual of each list; of empty ones 0."""

    rows: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def nearest(self, q: np.ndarray, index: Index, enough: int) -> list[np.ndarray]:
        """The nearest lists of each query until they hold enough rows."""
        order = _nearest(q, index.coarse, len(self.rows))
        n = (np.cumsum(self.rows[order], axis=1) < enough).sum(axis=1) + 1
        return [o[:m][self.rows[o[:m]] > 0] for o, m in zip(order, n, strict=True)]

    def possible(self, q: np.ndarray, index: Index, limit: np.ndarray) -> np.ndarray:
        """Which lists may hold rows not worse than the limits of the queries' scores."""
        squares = np.maximum(0, (q * q).sum(axis=1)[:, None] + (index.coarse * index.coarse).sum(axis=1) - 2 * q @ index.coarse.T)
        far, own = np.sqrt(squares), squares.argmin(axis=1)
        gap = np.stack([np.sqrt(((index.coarse - c) ** 2).sum(axis=1)) for c in index.coarse[own]])
        # A list's rows are at most as far from its centroid as from any other, the query's own for one.
        plane = np.divide(squares - squares.min(axis=1)[:, None] - SLACK, 2 * gap, out=np.zeros_like(gap), where=gap > 0)
        least = np.maximum(plane, np.maximum(far - self.most, self.least - far))
        return (least - SLACK_FAR <= np.sqrt(np.maximum(0, 2 - 2 * limit))[:, None]) & (self.rows > 0)


def search(vectors: DataFrame, is_query, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK, block_rows: int = BLOCK_ROWS,
           first_rows: int = FIRST_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row for which is_query(vec_id) holds."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    entries = _entries(rows, k)
    total = entries.count()
    if not total:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(unit(sample(entries, "vector", "vector", sample_rows, total)), lists=lists_for(total))
    indexed = materialize(_indexed(entries, index), "ann-index")
    sizes = {r.list: r for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("least"), F.max("radius").alias("most")).collect()}  # one row for each of at most max_lists
    lists = Lists(*(np.array([sizes[i][c] if i in sizes else 0 for i in range(len(index.coarse))]) for c in ("n", "least", "most")))
    n_blocks = -(-lists.rows // block_rows)
    kind, ids = (entries.schema[c].dataType.simpleString() for c in ("vector", "ids"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = lists.nearest(unit(matrix(part.column(1))), index, max(first_rows, k + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int64()))], names=["query_id", "vector", "lists"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                left = lists.possible(unit(matrix(part.column(1))), index, part.column(3).to_numpy())
                for row, done in enumerate(part.column(2).to_pylist()):
                    left[row, done] = False
                found = [np.flatnonzero(row) for row in left]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int64())), part.column(3)], names=["query_id", "vector", "lists", "limit"])

    cut = F.lit([int(n) for n in n_blocks])

    def answers(asked: DataFrame) -> DataFrame:
        """The k best so far of queries (query_id, vector, lists, limit) in the blocks of their lists."""
        asked = asked.select("query_id", "vector", "limit", F.explode("lists").alias("list"))
        asked = asked.select("list", F.explode(F.sequence(F.lit(0).cast("long"), (cut[F.col("list").cast("int")] - 1).cast("long"))).alias("block"), F.lit(1).alias("asks"), "query_id", "limit", "vector",
                             F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("radius"), F.lit(None).cast("double").alias("remainder"), F.lit(None).cast(ids).alias("ids"))
        kept = indexed.select("list", F.pmod(F.xxhash64(F.col("ids")[0]), cut[F.col("list").cast("int")]).cast("long").alias("block"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("query_id"),
                              F.lit(None).cast("double").alias("limit"), "vector", "code", "radius", "remainder", "ids")
        both = kept.unionByName(asked).repartition("list", "block").sortWithinPartitions("list", "block", "asks")
        return both.mapInArrow(lambda it: _search(it, index, k, rerank), "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    # A query's id and vector: usable rows of the main length are just those whose vector is an entry.
    asked = rows.filter(is_query(F.col("vec_id"))).filter(usable(F.col("vector")) & (F.size("vector") == index.coarse.shape[1])).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = materialize(asked.mapInArrow(near, f"query_id long, vector {kind}, lists array<long>"), "ann-queries")
    first = materialize(ranked(answers(asked.withColumn("limit", F.lit(NONE)))), "ann-first")
    limits = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("limit"))
    rest = asked.join(limits, "query_id", "left").select("query_id", "vector", "lists", F.coalesce("limit", F.lit(NONE)).alias("limit"))
    rest = answers(rest.mapInArrow(others, f"query_id long, vector {kind}, lists array<long>, limit double"))
    return ranked(first.select("query_id", "vec_id", "score").unionByName(rest))
