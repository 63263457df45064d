"""Packing documents into fixed-length sequences: first-fit decreasing with a tournament tree.

Documents become token ids, each followed by the end id, cut into pieces of at
most ``length`` ids. Pieces are dealt into groups by a seeded hash; in each
group, independently, pieces go in order of decreasing length into the first
sequence with room, found by descending a tournament tree of the sequences'
free capacities. Groups are sized from the total bytes, so one fits a task.

Null texts count as empty (a piece of just the end id). Rows that share an id,
or have none, are dealt by their texts. Repeated rows are packed each on its own;
those that a task meets again go to other groups, so that one group gets at most
one of them from each task. An empty table gives no sequences. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text for each group, on average; and partitions of the shuffle by group.
GROUP_BYTES, MOST_TASKS = 16 << 20, 1 << 16
#: From a million signs on, a run of white space is more than the rank-based library's pattern can match; runs of this length go another way.
LONG_SPACE = 100_000
_LONG = re.compile(rf"(?<!\s)\s{{{LONG_SPACE}}}")
_ENCODERS: dict[str, TextEncoder] = {}


class TextEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers. It keeps nothing of the texts.

    The byte-level BPE of a tokenizers .json file is run by tiktoken with the
    file's own vocabulary as ranks, which is the same merge order where each
    merge makes the token that follows the one before; that is checked on loading.
    Texts with a very long run of white space are encoded by tokenizers itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if any(b <= a for a, b in zip(made, made[1:], strict=False)) or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} isn't a byte-level BPE whose ids follow its merges")
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in visible]
        back = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        from public_tokenizers import PATTERN

        self.bpe = tiktoken.Encoding("texts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def ids(self, text: str, *, special: bool = True) -> np.ndarray:
        """Strings of special tokens inside the text are these tokens, or without ``special`` plain text."""
        if len(text) >= LONG_SPACE and _LONG.search(text):
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(self.path)  # such texts are rare, so it isn't kept
            library.encode_special_tokens = not special
            return np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.bpe.encode_to_numpy(text, allowed_special=set(self.special) if special else set(), disallowed_special=()).astype("<u4", copy=False)

    def __call__(self, text: str) -> bytes:
        return self.ids(text).tobytes()


def encoder(path: str) -> TextEncoder:
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length its bin and its offset there; ties keep their order.

    The tree's leaves are the bins' free capacities, an inner node the larger
    of its two, so the leftmost bin with room is found in log(n) steps.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int(np.searchsorted(-lengths[order], -capacity, side="right"))
    bins[order[:full]] = np.arange(full)  # whole sequences, alone
    rest = order[full:]
    leaves = 1 << max(1, (len(rest) - 1).bit_length()) if len(rest) else 2
    free = [capacity] * (2 * leaves)
    for k in rest.tolist():
        size, node = int(lengths[k]), 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins[k], offsets[k] = full + node - leaves, capacity - free[node]
        free[node] -= size
        while node > 1:
            node //= 2
            larger = max(free[2 * node], free[2 * node + 1])
            if free[node] == larger:
                break
            free[node] = larger
    return bins, offsets


def _pieces_schema(id_type: T.DataType) -> list[T.StructField]:
    return [T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType())]


def pieces(docs: DataFrame, path: str, *, length: int = 2048, end_id: int = 1, n_groups: int = 1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, ids, doc_tokens, group): every id of every document in exactly one piece."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("draw"))
    end, step = np.array([end_id], dtype="<u4").tobytes(), 4 * length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        met: Counter[int] = Counter()  # a number for each row of the task, so bounded by the size of its input
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                index, start, ids, tokens, group = [], [], [], [], []
                for i, (text, draw) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    whole = encode(text) + end
                    copy, met[draw] = met[draw], met[draw] + 1
                    for k, s in enumerate(range(0, len(whole), step)):
                        index.append(i)
                        start.append(s // 4)
                        ids.append(whole[s:s + step])
                        tokens.append(len(whole) // 4)
                        # The pieces of a long document go to different groups, and so do repeated rows.
                        group.append((draw + k * 0x9E3779B97F4A7C15 + copy * 0xC2B2AE3D27D4EB4F >> 16) % n_groups)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(index, pa.int64())), pa.array(start, pa.int64()), pa.array(ids, pa.binary()), pa.array(tokens, pa.int64()), pa.array(group, pa.int64())],
                    names=["doc_id", "start", "ids", "doc_tokens", "group"])

    schema = T.StructType([*_pieces_schema(rows.schema["doc_id"].dataType), T.StructField("group", T.LongType())])
    return rows.mapInArrow(cut, schema)


def pack(docs: DataFrame, path: str, *, length: int = 2048, end_id: int = 1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, ids, doc_tokens, sequence_id, offset): where each piece lies; ids are little-endian unsigned 32-bit."""
    n_bytes = docs.agg(F.sum(F.octet_length(text_col)), F.count(F.lit(1))).first()
    n_groups = max(1, -(-((n_bytes[0] or 0) + 4 * n_bytes[1]) // GROUP_BYTES))
    cut = pieces(docs, path, length=length, end_id=end_id, n_groups=n_groups, seed=seed, id_col=id_col, text_col=text_col)

    def fit(table: pa.Table) -> pa.Table:
        # Sorted by content, so that a task that is run again packs alike.
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("doc_tokens", "ascending"), ("ids", "ascending")])
        lengths = np.array([len(x) // 4 for x in table["ids"].to_pylist()], dtype=np.int64)
        bins, offsets = first_fit_decreasing(lengths, length)
        group = table["group"][0].as_py()
        return pa.table([table["doc_id"], table["start"], table["ids"], table["doc_tokens"], pa.array((group << 24) + bins), pa.array(offsets)], schema=out)

    id_type = cut.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*_pieces_schema(id_type), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    out = to_arrow_schema(schema)
    # A task for about each group; above MOST_TASKS groups a task takes several, one after the other, with the same results.
    return cut.repartition(min(int(n_groups), MOST_TASKS), "group").groupBy("group").applyInArrow(fit, schema)


def packing_digest(docs: DataFrame, path: str, **options) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of pack()."""
    return pack(docs, path, **options).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
