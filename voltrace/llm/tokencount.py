"""Token counts: pieces are counted once per distinct pre-token, then joined to documents' frequencies.

Pre-tokens are the units of voltrace.llm.units. Three passes, none of which
holds token ids:

1. frequencies of pre-tokens over all documents, summed within tasks first;
2. each distinct pre-token is encoded once, giving its number of pieces;
3. documents' pre-token frequencies are joined with the pieces and summed. The
   ``head_rows`` most frequent pre-tokens, a bounded dictionary, are broadcast
   and summed where the documents are read; the rest, a few hundredths of all
   occurrences, are joined by a shuffle on the pre-token.

Null and empty texts have 0 tokens and bytes. Repeated rows give repeated
results. Other columns are not read.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltrace.llm.units import units
from voltrace.runtime import materialize

HEAD_ROWS = 1 << 18
#: Distinct pre-tokens that a task holds before it passes them on.
FLUSH_ROWS = 1 << 18
_ENCODERS: dict[str, Callable[[list[str]], list[int]]] = {}


def piece_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Numbers of tokens of texts, by the library for the file: tokenizers for .json, sentencepiece for .model."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(path)
            _ENCODERS[path] = lambda texts: [len(e.ids) for e in made.encode_batch_fast(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            _ENCODERS[path] = lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"no library for {path}")
    return _ENCODERS[path]


def splitter(path: str) -> Callable[[str], list[str]]:
    """Pre-tokens of a text for this file. sentencepiece has no independent units, so there a text is one."""
    return units if path.endswith(".json") else lambda text: [text] if text else []


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield part, part.column(column).to_pylist()


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """(unit, freq, pieces) of every distinct pre-token of (key, text) rows."""
    split = splitter(path)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            rows = iter(seen.items())
            while part := list(islice(rows, 20_000)):
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["unit", "freq"])
            seen.clear()

        for _, texts in _texts(batches, 0):
            for text in texts:
                if text:
                    seen.update(split(text))
            if len(seen) > FLUSH_ROWS:
                yield from out()
        yield from out()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_counter(path)
        for part, texts in _texts(batches, 0):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(count(texts), pa.int64())], names=["unit", "freq", "pieces"])

    freqs = docs.select("text").mapInArrow(tally, "unit string, freq long").groupBy("unit").agg(F.sum("freq").alias("freq"))
    return freqs.mapInArrow(encode, "unit string, freq long, pieces long")


def token_counts(docs: DataFrame, path: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", head_rows: int = HEAD_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    vocab = materialize(vocabulary(rows, path), "tokens-vocabulary")
    # The head: all pre-tokens above the lowest frequency step that leaves at most head_rows.
    step = F.floor(F.log2("freq") * 16)
    steps = vocab.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect()  # at most 16 * 64 rows
    least = min((s.step for s, n in zip(steps, accumulate(s.n for s in steps), strict=True) if n <= head_rows), default=1 << 20)
    top = vocab.filter(step >= least).select("unit", "pieces").toArrow()
    head = docs.sparkSession.sparkContext.broadcast(dict(zip(top["unit"].to_pylist(), top["pieces"].to_pylist(), strict=True)))
    del top
    split = splitter(path)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each document a row of_text, with the head's tokens and the text's hash as its unit; and a row for each other pre-token."""
        known = head.value
        for part, texts in _texts(batches, 3):
            index, unit, of_text, freq, tokens = [], [], [], [], []
            prints = [str(x) for x in part.column(1).to_pylist()]
            for i, text in enumerate(texts):
                found, rest = 0, []
                for u in split(text):
                    n = known.get(u)
                    if n is None:
                        rest.append(u)
                    else:
                        found += n
                more = Counter(rest) if rest else {}
                index += [i] * (1 + len(more))
                unit += [prints[i], *more]
                of_text += [True] + [False] * len(more)
                freq += [1, *more.values()]
                tokens += [found] + [0] * len(more)
            at = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), part.column(1).take(at), part.column(2).take(at), pa.array(unit, pa.string()), pa.array(of_text), pa.array(freq, pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "print", "n_bytes", "unit", "of_text", "freq", "tokens"])

    keyed = rows.select("doc_id", F.xxhash64("text").alias("print"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    schema = T.StructType([T.StructField("doc_id", keyed.schema["doc_id"].dataType), *(T.StructField(x, T.LongType()) for x in ("print", "n_bytes")),
                           T.StructField("unit", T.StringType()), T.StructField("of_text", T.BooleanType()), T.StructField("freq", T.LongType()), T.StructField("tokens", T.LongType())])
    parts = keyed.mapInArrow(frequencies, schema)
    # A row of_text matches nothing and keeps its tokens; its unit spreads such rows over the join's tasks.
    joined = parts.join(vocab.select("unit", F.lit(False).alias("of_text"), "pieces"), ["unit", "of_text"], "left")
    sums = joined.groupBy("doc_id", "print", "n_bytes").agg(
        F.sum(F.coalesce(F.col("pieces") * F.col("freq"), F.col("tokens"))).alias("tokens"), F.count_if("of_text").alias("copies"))
    # Rows that repeat both id and text are counted together above, and told apart again here.
    each = sums.select("doc_id", "n_bytes", (F.col("tokens") / F.col("copies")).cast("long").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
