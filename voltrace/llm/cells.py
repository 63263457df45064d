"""Shared machinery of the pair operators: bounded cells of a bucket, and connected components.

A bucket (rows of one retrieval key) with more rows than ``cell_rows`` is cut
into chunks by a hash of the row, and each pair of chunks becomes a cell of its
own; smaller buckets are one cell. Every pair of rows of a bucket meets in
exactly one cell, no cell holds more than about twice ``cell_rows`` rows, and
inside a cell links are counted or reduced to a spanning forest, so that no
operator emits all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrace.runtime import materialize, scratch

CELL_ROWS, PART_ROWS = 4096, 512


def into_cells(rows: DataFrame, key: str, item: str, cell_rows: int = CELL_ROWS, *, size: Column | None = None, cell_size: int = 1) -> DataFrame:
    """Adds cell_i, cell_j and own (the row's chunk), one row for each cell that the row is in.

    The result is partitioned and sorted by (key, cell_i, cell_j). With a ``size`` of rows, buckets of more than ``cell_size`` are cut too, so
    that a chunk holds about that much (a row that is larger by itself is still one row).
    """
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.lit(0) if size is None else size).alias("size")]
    parts = F.greatest(F.ceil(F.col("n") / cell_rows), F.least(F.ceil(F.col("size") / cell_size), F.col("n")))
    chunks = rows.groupBy(key).agg(*sums).select(key, parts.cast("int").alias("chunks")).filter("chunks > 1")
    cut = rows.join(chunks, key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64(item), F.col("chunks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    cut = cut.withColumn("cell_i", F.least("own", "other")).withColumn("cell_j", F.greatest("own", "other")).drop("other")
    cells = [key, "cell_i", "cell_j"]
    return cut.repartition(*cells).sortWithinPartitions(*cells)


def _numpy(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return column.to_numpy(zero_copy_only=False)


def iter_cells(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """The cells of two rows or more, as arrays by column, from batches sorted by into_cells."""
    cells = [key, "cell_i", "cell_j"]
    kept: dict[str, list[np.ndarray]] | None = None

    def joined(parts: dict[str, list[np.ndarray]]) -> dict[str, np.ndarray]:
        return {k: v[0] if len(v) == 1 else np.concatenate(v) for k, v in parts.items()}

    for batch in (b.slice(at, PART_ROWS) for b in batches for at in range(0, b.num_rows, PART_ROWS)):  # texts of a whole batch would be in memory twice
        cols = {name: _numpy(batch.column(i)) for i, name in enumerate(batch.schema.names)}
        change = np.zeros(batch.num_rows, dtype=bool)
        for name in cells:
            change[1:] |= cols[name][1:] != cols[name][:-1]
        if kept is not None:
            change[0] = any(kept[name][-1][-1] != cols[name][0] for name in cells)
        starts = np.flatnonzero(change)
        if kept is not None:
            head = starts[0] if len(starts) else batch.num_rows
            for name, parts in kept.items():
                parts.append(cols[name][:head])
            if not len(starts):
                continue
            if sum(map(len, kept[key])) > 1:
                yield joined(kept)
        else:
            starts = np.concatenate(([0], starts)) if not len(starts) or starts[0] else starts
        ends = np.append(starts[1:], batch.num_rows)
        for a, b in zip(starts[:-1], ends[:-1], strict=True):
            if b - a > 1:
                yield {name: v[a:b] for name, v in cols.items()}
        kept = {name: [v[starts[-1]:]] for name, v in cols.items()}
    if kept is not None and sum(map(len, kept[key])) > 1:
        yield joined(kept)


def iter_blocks(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """As iter_cells, many cells at a time: columns of whole cells of two rows or more, and the cells' starts with the end appended."""
    kept: dict[str, np.ndarray] | None = None

    def whole(cols: dict[str, np.ndarray], starts: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray] | None:
        sizes = np.diff(starts)
        rows = np.repeat(sizes > 1, sizes)
        return ({name: v[rows] for name, v in cols.items()}, np.concatenate(([0], np.cumsum(sizes[sizes > 1])))) if rows.any() else None

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {name: _numpy(batch.column(i)) for i, name in enumerate(batch.schema.names)}
        if kept is not None:
            cols = {name: np.concatenate([kept[name], v]) for name, v in cols.items()}
        change = np.zeros(len(cols[key]), dtype=bool)
        for name in (key, "cell_i", "cell_j"):
            change[1:] |= cols[name][1:] != cols[name][:-1]
        starts = np.concatenate(([0], np.flatnonzero(change)))
        kept = {name: v[starts[-1]:] for name, v in cols.items()}
        if len(starts) > 1 and (out := whole({name: v[:starts[-1]] for name, v in cols.items()}, starts)) is not None:
            yield out
    if kept is not None and (out := whole(kept, np.array([0, len(kept[key])]))) is not None:
        yield out


def small_pairs(starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within all cells of at most ``most`` rows, a distance of one row after another."""
    sizes = np.diff(starts)
    end = np.repeat(np.where(sizes <= most, starts[1:], 0), sizes)
    at, left, right = np.flatnonzero(end), [], []
    for k in range(1, most):
        at = at[at + k < end[at]]
        if not len(at):
            break
        left.append(at)
        right.append(at + k)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, dtype=np.int64),) * 2


def meeting(own: np.ndarray, i: np.ndarray, j: np.ndarray, cell_i: int, cell_j: int) -> np.ndarray:
    """Which of the pairs (i, j) of a cell are its own: in a cell of two chunks, only pairs across them."""
    if cell_i == cell_j:
        return np.ones(len(i), dtype=bool)
    return own[i] != own[j]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n items over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def connected_components(edges: DataFrame, tag: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is its smallest node.

    Alternates large-star and small-star rounds until nothing changes. Minima
    are aggregated before the shuffle, and each round is written to the shared
    folder, so neither a hot node nor a lost executor matters.
    """
    a, b = F.col("a"), F.col("b")
    with scratch(edges.sparkSession):
        links = materialize(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(a != b).distinct(), f"{tag}-links")
        n = links.count()
        for round_ in range(max_rounds if n else 0):
            both = links.union(links.select(b.alias("a"), a.alias("b")))
            low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
            large = both.join(low, "a").filter(b > a).select(b.alias("a"), F.col("low").alias("b")).distinct()
            large = materialize(large, f"{tag}-large-{round_}")
            least = large.groupBy("a").agg(F.min("b").alias("low"))
            small = large.join(least, "a").select(F.explode(F.array(
                F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct(F.col("a").alias("a"), F.col("low").alias("b")),
            )).alias("e")).select("e.a", "e.b").filter(a != b).distinct()
            new = materialize(small, f"{tag}-small-{round_}")
            # Both sets are duplicate-free, so they are equal if they count alike and none is outside the other.
            before, n = n, new.count()
            changed = n != before or not new.join(links, ["a", "b"], "left_anti").isEmpty()
            links = new
            if not changed:
                break
        else:
            if n:
                raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        nodes = links.select(a.alias("node"), b.alias("component"))
        return materialize(nodes.union(links.select(b, b)).distinct(), f"{tag}-components", keep=True)
