"""SimHash near-duplicates with pivot distance tables.

A text's fingerprint has bit i set if over half the hashes of its word
shingles (repeats included) have it. Texts without words have fingerprint
zero. Distinct fingerprints within ``max_bits`` differing bits are linked:

1. the Hamming distances of each fingerprint to the pivots, fixed reference
   fingerprints, are precomputed once as a table;
2. pairs meet in cells: fingerprints that agree on two of five bit blocks.
   With three differing bits at most three blocks differ, so no link is lost;
3. in a cell, pairs whose coordinates differ by more than ``max_bits`` at any
   pivot are discarded, as the triangle inequality forbids a link;
4. survivors are verified, and reduced to a spanning forest of their cell.

``similar_groups`` finds all texts whose shingle sets are similar, in two
rounds. First, texts that share two smallest hashes of a permutation meet in
cells; there pivot tables and fingerprints, as above but up to NEAR_BITS, choose
those whose texts are compared by the exact Jaccard similarity of their sets, in
chunks of the components that they make, each with the component's first text.
That links most near copies, but not all for certain. So then texts that are
not linked yet meet by the shingles that come first in an order with rare ones
ahead: similar sets share one of those (see ``prefix``). Those that meet are
compared exactly, too.

Copies share a fingerprint and are never expanded. Null texts count as empty;
a null id is never a component's id unless the component has no other; repeated
rows are rows of their own; an empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltrace.llm.cells import CELL_ROWS, connected_components, forest, into_cells, iter_blocks, iter_cells, meeting, small_pairs
from voltrace.runtime import materialize, scratch

HASH_SEED = 42
#: Widths of the bit blocks; each key is a pair of blocks.
BLOCKS = (13, 13, 13, 13, 12)
N_PIVOTS = 16
#: Shingles hashed, and pairs compared, at once.
CHUNK, PAIRS = 1 << 16, 1 << 20


def pivots(n: int = N_PIVOTS) -> list[int]:
    """Reference fingerprints: hashes of 0 to n - 1, as signed longs."""
    return [int(x) for x in np.array([xxhash.xxh64_intdigest(str(i), seed=7) for i in range(n)], dtype=np.uint64).view(np.int64)]


def fingerprint(text: bytes, width: int = 3) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text."""
    words = text.lower().split()  # of bytes: A-Z only, at \x20 and \x09-\x0D only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest = partial(xxhash.xxh64_digest, seed=HASH_SEED)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = words[at:min(at + CHUNK, n) + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
        hashes = np.frombuffer(b"".join(map(digest, shingles)), dtype=np.uint8).reshape(-1, 8)
        ones += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; texts stay where they were read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fps = [fingerprint(x or b"", width) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(run, schema)


def _table() -> F.Column:
    """The pivot table's row of a fingerprint."""
    return F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in pivots()])


def _keys(fps: DataFrame) -> DataFrame:
    """A row for each pair of blocks, with the pivot table's row."""
    shifts = [sum(BLOCKS[:k]) for k in range(len(BLOCKS))]
    block = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(shifts, BLOCKS, strict=True)]
    both = [(i, j) for i in range(len(BLOCKS)) for j in range(i)]
    key = [F.lit(k << 26).bitwiseOR(F.shiftleft(block[i], 13)).bitwiseOR(block[j]) for k, (i, j) in enumerate(both)]
    return fps.withColumn("table", _table()).withColumn("key", F.explode(F.array(*key)))


def close_pairs(fps: np.ndarray, table: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a cell within max_bits differing bits, by the pivot table and then by the fingerprints."""
    order = np.argsort(table[:, 0], kind="stable")
    table, bits = table[order].astype(np.int8), fps[order].view(np.uint64)
    stop = np.searchsorted(table[:, 0], table[:, 0] + max_bits, side="right")
    widths = stop - np.arange(len(fps)) - 1
    ends = np.cumsum(widths)
    at = 0
    while at < len(fps):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        w = widths[at:to]
        i = np.repeat(np.arange(at, to), w)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
        for p in range(1, table.shape[1]):
            near = np.abs(table[i, p] - table[j, p]) <= max_bits
            i, j = i[near], j[near]
            if len(i) < 64:
                break
        linked = np.bitwise_count(bits[i] ^ bits[j]) <= max_bits
        if linked.any():
            yield order[i[linked]], order[j[linked]]
        at = to


def _forests(keyed: DataFrame, max_bits: int, cell_rows: int) -> DataFrame:
    """Edges (a, b) of rows (key, fp, table): the forests of the links within max_bits of all cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in iter_cells(batches, "key"):
            fps, own, ci, cj = cell["fp"], cell["own"], cell["cell_i"][0], cell["cell_j"][0]
            pairs = [(i[ok], j[ok]) for i, j in close_pairs(fps, cell["table"], max_bits) for ok in [meeting(own, i, j, ci, cj)]]
            if not pairs:
                continue
            root = forest(len(fps), np.concatenate([x[0] for x in pairs]), np.concatenate([x[1] for x in pairs]))
            member = np.flatnonzero(root != np.arange(len(fps)))
            if len(member):
                yield pa.RecordBatch.from_arrays([pa.array(fps[root[member]]), pa.array(fps[member])], names=["a", "b"])

    return into_cells(keyed, "key", "fp", cell_rows).mapInArrow(run, "a long, b long").distinct()


def links(fps: DataFrame, max_bits: int = 3, cell_rows: int = 4096) -> DataFrame:
    """Edges (a, b) that connect just the fingerprints which links connect."""
    if max_bits > 3:
        raise ValueError("two of five blocks agree for certain only up to three differing bits")
    return _forests(_keys(fps), max_bits, cell_rows)


def components(prints: DataFrame, max_bits: int = 3, cell_rows: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) from rows (doc_id, fp)."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    groups = connected_components(links(distinct.select("fp"), max_bits, cell_rows), "simhash")
    known = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    known = materialize(known, "simhash-known")
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    by_print = materialize(known.join(least, "component").select("fp", "component_id"), "simhash-by-print")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): the digest of every row of docs."""
    prints = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "simhash-prints")
    found = components(prints, max_bits)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Groups by exact similarity -----------------------------------------------------

#: Texts from which common shingles are learned, occurrences there that make one common, and most of them that are kept.
SAMPLE_TEXTS, COMMON, MOST_COMMON = 10_000, 3, 100_000
#: Values that are broadcast at most to keep rows out of a shuffle.
POSITIONS = 1 << 20
#: Differing bits of fingerprints within which texts are compared first, and permutations by whose two smallest hashes these meet.
NEAR_BITS, BANDS = 16, 6
#: Rows of a cell that are compared together, pairs taken at once, and texts and their bytes that a chunk of a cell of the exact comparison holds.
SMALL_CELL, MET_PAIRS, TEXT_CELL, TEXT_BYTES = 48, 1 << 16, 512, 32 << 20


def shingle_set(text: bytes, width: int) -> frozenset:
    words = text.lower().split()
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    return frozenset(map(partial(xxhash.xxh3_64_intdigest, seed=HASH_SEED), shingles))


def bands(hashes: np.ndarray) -> np.ndarray:
    """For each of BANDS permutations of the hashes a mix of the two smallest."""
    out = []
    for k in range(BANDS):
        moved = (hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        moved ^= moved >> np.uint64(32)
        low = np.partition(moved, 1) if len(moved) > 1 else moved
        out.append(low[:1] * np.uint64(0x94D049BB133111EB) + low[:2][-1:] + np.uint64(k))
    return np.concatenate(out)


def prefix(shingles: frozenset, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles, sorted: 60 bits of the hash, below 4 bits that put those in ``common`` (sorted hashes, their counts) behind the others.

    Two sets as similar as asked share at least similarity * n shingles, n being the larger size or the smaller one. The
    first of those is, in either set, ahead of all others shared, so at most n - ceil(similarity * n) come before it.
    """
    hashes = np.fromiter(shingles, dtype=np.uint64, count=len(shingles))
    level = np.zeros(len(hashes), dtype=np.uint64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], hashes), len(common[0]) - 1)
        level = np.where(common[0][at] == hashes, np.minimum(15, np.log2(common[1][at])), 0).astype(np.uint64)
    ahead = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    return np.sort((level << np.uint64(60)) | (hashes >> np.uint64(4)))[:ahead]


def brief(keys: np.ndarray) -> np.ndarray:
    """The upper halves of the keys of a prefix, in order, for may_be_similar."""
    return (keys >> np.uint64(32)).astype(np.uint32)


def may_be_similar(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, similarity: float) -> bool:
    """False if the brief prefixes of two sets of n_a and n_b shingles prove them less similar: ahead of the end of the one that ends first, too many are not shared.

    Different shingles whose halves agree only make this True more often.
    """
    last = min(a[-1], b[-1])
    a, b = a[:np.searchsorted(a, last)], b[:np.searchsorted(b, last)]

    def alone(x: np.ndarray, y: np.ndarray) -> int:
        return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] != x).sum()) if len(y) else len(x)

    least = similarity / (1 + similarity) * (n_a + n_b) - 1e-9
    return alone(a, b) <= n_a - least and alone(b, a) <= n_b - least


def maybe_in(rows: DataFrame, asked: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Rows whose column may be in asked's (left_semi), or surely isn't (left_anti), so that few rows need be shuffled for an exact join.

    At most POSITIONS values, remainders of hashes, are broadcast, whatever the size of asked.
    """
    at = F.pmod(F.xxhash64(F.lit(6), column), F.lit(POSITIONS))
    return rows.withColumn("__at", at).join(F.broadcast(asked.select(at.alias("__at")).distinct()), "__at", how).drop("__at")


def _common(keyed: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of shingles that several texts of a bounded sample hold. They only order shingles, so any sample gives the same links."""
    draw = F.pmod(F.xxhash64(F.lit(3), "h1"), F.lit(1 << 30))
    rows = keyed.filter(draw < F.lit(int(min(1.0, SAMPLE_TEXTS / max(1, keyed.count())) * (1 << 30)))).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            sets = [np.fromiter(shingle_set(t, width), dtype=np.uint64) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["key"])

    found = rows.mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON)
    kept = found.orderBy(F.desc("n"), "key").limit(MOST_COMMON).collect()
    hashes = np.array([r.key for r in kept], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r.n for r in kept], dtype=np.int64)[order]


def _groups(cid: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(meeting, cid) of groups of two or more; a meeting is named by the smallest hash of a member, so those who meet by several keys, with others or without, mostly do so once."""
    order = np.argsort(group, kind="stable")
    begin = np.flatnonzero(np.diff(group[order], prepend=-1))
    sizes = np.diff(np.append(begin, len(order)))
    if (sizes > 1).any():
        mixed = cid[order].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        meeting = np.repeat(np.minimum.reduceat(mixed ^ (mixed >> np.uint64(31)), begin), sizes)
        several = np.repeat(sizes > 1, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(meeting[several].view(np.int64)), pa.array(cid[order][several])], names=["meeting", "cid"])


def _meetings(classes: DataFrame, keys_of: DataFrame, similarity: float, cell_rows: int) -> DataFrame:
    """(meeting, cid) from rows (cid, n, label) and (cid, keys): classes that share a key and could be similar by their sizes, and are not linked yet."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            keys = [np.frombuffer(k, dtype=np.int64) for k in part.column(1).to_pylist()]
            times = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), part.column(0).take(pa.array(times))], names=["key", "cid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in iter_blocks(batches, "key"):
            cid, n, label, own, across = cols["cid"], cols["n"], cols["label"], cols["own"], cols["cell_i"] != cols["cell_j"]
            nodes = np.arange(len(cid))
            group = nodes

            def add(i: np.ndarray, j: np.ndarray) -> None:
                nonlocal group
                ok = (label[i] != label[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9) & (~across[i] | (own[i] != own[j]))
                if ok.any():
                    group = forest(len(cid), np.concatenate([nodes, i[ok]]), np.concatenate([group, j[ok]]))

            i, j = small_pairs(starts, SMALL_CELL)
            for at in range(0, len(i), MET_PAIRS):
                add(i[at:at + MET_PAIRS], j[at:at + MET_PAIRS])
            for k in np.flatnonzero(np.diff(starts) > SMALL_CELL):
                first, end = starts[k], starts[k + 1]
                for at in range(first, end, 16):
                    i, j = np.nonzero(np.arange(at, min(at + 16, end))[:, None] < np.arange(at, end)[None])
                    add(i + at, j + at)
            yield from _groups(cid, group)

    rows = keys_of.select("cid", "keys").mapInArrow(keyed, "key long, cid long").filter("key is not null").repartition("key")  # dealt once, for the counts and for the join
    several = rows.groupBy("key").agg(F.count("cid").alias("rows")).filter(F.col("rows") > 1).select("key")
    shared = materialize(rows.join(several, "key", "left_semi"), "similar-shared")  # most keys are of one class
    return into_cells(shared.join(classes.select("cid", "n", "label"), "cid"), "key", "cid", cell_rows).mapInArrow(run, "meeting long, cid long").distinct()


def _brief_keys(classes: DataFrame) -> DataFrame:
    """(cid, keys) with brief keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [brief(np.frombuffer(k, dtype=np.uint64)).tobytes() for k in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["cid", "keys"])

    return classes.select("cid", "keys").mapInArrow(run, "cid long, keys binary")


def _possible(met: DataFrame, similarity: float, cell_rows: int) -> DataFrame:
    """The meetings (meeting, cid) that are left of rows (meeting, cid, n, label, brief keys), without the pairs that the keys rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in iter_cells(batches, "meeting"):
            n, label, own, across = cell["n"], cell["label"], cell["own"], cell["cell_i"][0] != cell["cell_j"][0]
            keys = [np.frombuffer(k, dtype=np.uint32) for k in cell["keys"]]
            group = np.arange(len(n))
            for i in range(1, len(n)):
                near = (np.minimum(n[:i], n[i]) >= similarity * np.maximum(n[:i], n[i]) - 1e-9) & (label[:i] != label[i])
                near = np.flatnonzero(near & ((own[:i] != own[i]) if across else True))
                while len(near := near[group[near] != group[i]]):
                    j, near = int(near[0]), near[1:]
                    if may_be_similar(keys[i], keys[j], int(n[i]), int(n[j]), similarity):
                        low, high = sorted((group[i], group[j]))
                        group[group == high] = low
            yield from _groups(cell["cid"], group)

    return into_cells(met, "meeting", "cid", cell_rows).mapInArrow(run, "meeting long, cid long").distinct()


def _verified(texts: DataFrame, width: int, similarity: float, cell_rows: int, cell_bytes: int = TEXT_BYTES) -> DataFrame:
    """Edges (a, b) that link classes of different labels whose shingle sets are similar, from rows (meeting, cid, n, label, bytes, text): forests of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in iter_cells(batches, "meeting"):
            size, across, own = cell["n"], cell["cell_i"][0] != cell["cell_j"][0], cell["own"]
            n = len(size)
            sets: list[np.ndarray | None] = [None] * n
            _, first, inverse = np.unique(cell["label"], return_index=True, return_inverse=True)
            label = first[inverse]
            known = np.unique(label)
            for i in range(1, n):
                near = np.minimum(size[:i], size[i]) >= similarity * np.maximum(size[:i], size[i]) - 1e-9
                near = np.flatnonzero(near & ((own[:i] != own[i]) if across else True))
                while len(near := near[label[near] != label[i]]):  # those that are linked already need no comparison
                    j, near = int(near[0]), near[1:]
                    for k in (i, j):
                        if sets[k] is None:
                            sets[k] = np.sort(np.fromiter(shingle_set(cell["text"][k], width), dtype=np.uint64))
                            cell["text"][k] = None  # its set takes its place
                    a, b = sets[i], sets[j]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if both >= similarity * (len(a) + len(b) - both) - 1e-9:
                        low, high = sorted((label[i], label[j]))
                        label[label == high] = low
            new = known[label[known] != known]  # what was linked before is not linked again
            if len(new):
                yield pa.RecordBatch.from_arrays([pa.array(cell["cid"][label[new]]), pa.array(cell["cid"][new])], names=["a", "b"])

    return into_cells(texts, "meeting", "cid", cell_rows, size=F.col("bytes"), cell_size=cell_bytes).mapInArrow(run, "a long, b long")


def _near_prints(classes: DataFrame, text_cell: int) -> DataFrame:
    """(meeting, cid) from rows (cid, fp, bands): the texts of components of close fingerprints, in chunks of about text_cell, with the component's first text in each."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            keys = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], names=["key", "fp"])

    rows = classes.select("fp", "bands").mapInArrow(keyed, "key long, fp long").distinct()
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1).select("key")
    rows = rows.join(several, "key", "left_semi").withColumn("table", _table())
    groups = connected_components(_forests(rows, NEAR_BITS, CELL_ROWS), "similar-prints")
    member = classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("cid", F.coalesce("component", "fp").alias("component"))
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.min("cid").alias("root")).filter(F.col("members") > 1)
    chunks = F.ceil(F.col("members") / text_cell).cast("int")
    chunk = F.when(F.col("cid") == F.col("root"), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(F.pmod(F.xxhash64("cid"), chunks).cast("int")))
    return member.join(sizes, "component").select("component", "cid", F.explode(chunk).alias("chunk")).select(F.xxhash64("component", "chunk").alias("meeting"), "cid")


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, cell_rows: int = TEXT_CELL, cell_bytes: int = TEXT_BYTES) -> DataFrame:
    """(doc_id, component_id, h1, h2, kept) of every row: components of texts whose sets of width-word shingles have a Jaccard similarity of at least ``similarity``.

    All such pairs are found, and no others are linked (shingles are compared as 64-bit hashes). h1 and h2 are hashes of
    the text; kept are rows of the text that stands for the component, the one with the smallest id and then hashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.cast("binary").alias("text"))
    common = _common(keyed, width)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            texts = part.column(3).to_pylist()
            sets = [shingle_set(t, width) for t in texts]
            made = pa.array([prefix(s, similarity, common).tobytes() for s in sets], pa.binary())
            prints = pa.array([fingerprint(t, width) for t in texts], pa.int64())
            low = pa.array([bands(np.fromiter(s, dtype=np.uint64, count=len(s))).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array([len(s) for s in sets], pa.int64()), prints, low, made], names=["doc_id", "h1", "h2", "n", "fp", "bands", "keys"])

    schema = T.StructType([T.StructField("doc_id", keyed.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("h1", "h2", "n", "fp")), *(T.StructField(c, T.BinaryType()) for c in ("bands", "keys"))])
    with scratch(docs.sparkSession):
        rows = materialize(keyed.mapInArrow(keys, schema), "similar-keys")
        classes = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), *(F.min(c).alias(c) for c in ("n", "fp", "bands", "keys"))).withColumn("cid", F.monotonically_increasing_id())
        classes = materialize(classes, "similar-classes")

        def verified(met: DataFrame, labelled: DataFrame, most: int, tag: str) -> DataFrame:
            asked = materialize(met.join(labelled.withColumnRenamed("first", "__first"), "cid"), f"similar-asked-{tag}")
            # One row of each class brings its text; rows that repeat it drop out by the class.
            texts = maybe_in(keyed, asked, "h1").join(asked, ["h1", "h2"]).filter(F.col("doc_id").eqNullSafe(F.col("__first")))
            texts = materialize(texts.select("meeting", "cid", "n", "label", F.octet_length("text").cast("long").alias("bytes"), "text").dropDuplicates(["meeting", "cid"]), f"similar-texts-{tag}")
            return materialize(_verified(texts, width, similarity, most, cell_bytes), f"similar-verified-{tag}")

        known = classes.select("cid", "n", "h1", "h2", "first")
        near = materialize(_near_prints(classes.select("cid", "fp", "bands"), cell_rows), "similar-near")
        groups = connected_components(verified(near, known.withColumn("label", F.col("cid")), 2 * cell_rows, "near"), "similar-first")
        labelled = known.join(groups.select(F.col("node").alias("cid"), F.col("component").alias("label")), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        labelled = materialize(labelled, "similar-labelled")
        met = materialize(_meetings(labelled.select("cid", "n", "label"), classes, similarity, CELL_ROWS), "similar-meetings")
        keys_met = _brief_keys(maybe_in(classes, met, "cid"))
        met = materialize(_possible(met.join(labelled.select("cid", "n", "label"), "cid").join(keys_met, "cid"), similarity, CELL_ROWS), "similar-possible")
        more = verified(met, labelled, cell_rows, "rest")
        if not more.isEmpty():
            groups = connected_components(more.union(groups.select("component", "node")), "similar-links")
        known = classes.join(groups.select(F.col("node").alias("cid"), F.col("component")), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        known = materialize(known.select("h1", "h2", "first", "component"), "similar-known")
        least = known.groupBy("component").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "h1", "h2")).alias("least"))
        same = (F.col("h1") == F.col("least.h1")) & (F.col("h2") == F.col("least.h2"))
        by_class = known.join(least, "component").select("h1", "h2", F.col("least.first").alias("component_id"), same.alias("kept"))
        found = rows.select("doc_id", "h1", "h2").join(by_class, ["h1", "h2"]).select("doc_id", "component_id", "h1", "h2", "kept")
        return materialize(found, "similar-groups", keep=True)


def first_of_each_group(docs: DataFrame, groups: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that another stands for: of each component of groups (doc_id, component_id) the row of its id stays, with all its columns.

    If groups has the columns h1, h2 and kept of similar_groups, the row of that id and text stays, so that components
    that share an id lose no text. Otherwise, of rows that repeat that id, the one with the smallest text hash stays.
    Rows without an id all stay. Rows of ids that surely lose none are not shuffled.
    """
    stands = F.col("doc_id") == F.col("component_id")
    keys = ["__id"]
    rows = docs.withColumn("__id", F.col(id_col))
    if "kept" in groups.columns:
        stands, keys = stands & F.col("kept"), ["__id", "__h1", "__h2"]
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = rows.withColumn("__h1", F.xxhash64(text)).withColumn("__h2", F.xxhash64(F.lit(1), text))
    named = groups.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id"), *(F.col(k.strip("_")).alias(k) for k in keys[1:]), F.coalesce(stands, F.lit(False)).alias("__stands"))
    # Of every key: does it stand for its component, and how many rows has it.
    counted = named.groupBy(*keys).agg(F.bool_or("__stands").alias("__stands"), F.count(F.lit(1)).alias("__n"))
    touched = materialize(counted.filter(~F.col("__stands") | (F.col("__n") > 1)), "simhash-touched")
    asked = rows.filter(F.col("__id").isNotNull())
    sure = maybe_in(asked, touched, "__id", "left_anti")
    open_ = maybe_in(asked, touched, "__id").join(touched, keys, "left").filter(F.coalesce("__stands", F.lit(True)))
    stay = open_.filter(F.coalesce("__n", F.lit(1)) == 1)
    if not touched.filter("__stands and __n > 1").isEmpty():
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(text_col), F.col(text_col)))
        stay = stay.unionByName(open_.filter(F.col("__n") > 1).withColumn("__nth", nth).filter(F.col("__nth") == 1).drop("__nth"))
    return sure.select(*docs.columns).unionByName(stay.select(*docs.columns)).unionByName(docs.filter(F.col(id_col).isNull()))
