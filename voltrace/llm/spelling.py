"""Spelling variants: words one edit apart, found by a join of two chunks with positional grams.

Of two words that differ by one inserted, deleted or replaced code point, the
shorter (of equal length: the smaller) contributes two disjoint chunks, its first
and its last half; the other contributes its positional grams of that length. One
edit leaves one of the chunks whole, at most one place away. So both words meet
under (length of the chunks' word, chunk, place), with grams entered at places
within one of theirs; as chunks stand only at the first and at the last place,
only grams near those are entered. What meets is verified by a threshold edit
distance inside the join, so only true pairs leave it, once by the chunk that
they meet under first. Chunks that many words share are salted: their grams are
dealt over parts, their chunks copied to each.

Each word's form is its most frequent near word, if that is much more frequent;
roots follow forms by pointer doubling. A form is at least ``factor`` times as
frequent as its word, so chains are short.

Null and empty texts have no words; a null doc_id counts as an empty one.
Repeated rows count each. An empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrace.runtime import materialize

#: Runs of letters; a word has LEAST_POINTS code points and LEAST_COUNT occurrences at least; every SLIP_EVERYth run of a document by its hash loses a code point.
RUN, LEAST_POINTS, LEAST_COUNT, SLIP_EVERY = r"[A-Za-zÀ-ÿ]", 6, 5, 199
#: How often a form occurs at least, as a multiple of its word.
FACTOR = 5
#: Grams of one key that stay in one part.
KEY_ROWS = 2048


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT, slip_every: int = SLIP_EVERY) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, some of them with a code point deleted, that are long and frequent enough."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # A match of so many letters or more starts where its run starts, as shorter runs have none.
    runs = F.regexp_extract_all(F.translate(text_col, upper, lower), F.lit(f"({RUN}{{{least_points},}})"), 1)
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = each.select(F.when(h % slip_every == 0, slipped).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.filter((F.char_length("word") >= least_points) & (F.col("n") >= least_count))


def _chunk(word: Column, size: Column, last: bool) -> Column:
    half = F.floor(size / 2).cast("int")
    return F.substring(word, size - half + 1 if last else F.lit(1), half)


def _keyed(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks and grams (key, word, n, size) whose keys are equal where they may belong to words one edit apart."""
    size = F.char_length("word")
    rows = words.select("word", "n", size.alias("size"))
    chunks = rows.select("word", "n", "size", F.explode(F.array(*(
        F.struct(F.lit(last).alias("last"), _chunk(F.col("word"), F.col("size"), last).alias("gram")) for last in (False, True)))).alias("k"))
    # Partners of equal length keep their places; in one that is longer by a code point, a chunk is at its place or at the next.
    entries = []
    for longer in (0, 1):
        of = F.col("size") - longer
        half = F.floor(of / 2).cast("int")
        for last in (False, True):
            for shift in range(longer + 1):
                place = (of - half if last else F.lit(0)) + shift
                entries.append(F.struct(of.alias("of"), F.lit(last).alias("last"), F.substring("word", place + 1, half).alias("gram")))
    grams = rows.select("word", "n", "size", F.explode(F.array_distinct(F.array(*entries))).alias("k")).filter("k.of > 1")
    return (chunks.select(F.col("size").alias("of"), "k.last", "k.gram", "word", "n", "size"), grams.select("k.of", "k.last", "k.gram", "word", "n", "size"))


def near_pairs(words: DataFrame, *, key_rows: int = KEY_ROWS) -> DataFrame:
    """(word, n, near, near_n): each pair of different words (word, n) one edit apart, once."""
    key = ["of", "last", "gram"]
    chunks, grams = _keyed(words)
    hot = grams.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > key_rows).select(*key, F.ceil(F.col("rows") / key_rows).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    left = chunks.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    right = grams.join(hot, key, "left").withColumn("part", F.pmod(F.xxhash64("word"), parts).cast("int")).drop("parts")
    right = right.select(*key, "part", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("size").alias("near_size"))
    # The shorter word has the chunks, the smaller one of two equal lengths. Pairs that meet under both chunks count under the first.
    first = (F.col("near_size") > F.col("size")) | (F.col("word") < F.col("near"))
    once = ~F.col("last") | ~_meets_first()
    verified = F.levenshtein("word", "near", 1) == 1
    return left.join(right, [*key, "part"]).filter(first & once & verified).select("word", "n", "near", "near_n")


def _meets_first() -> Column:
    """Whether the first chunk of word is in near within the places that the join looks at."""
    half = F.floor(F.col("size") / 2).cast("int")
    chunk = F.substring("word", F.lit(1), half)
    return (chunk == F.substring("near", F.lit(1), half)) | ((F.col("near_size") > F.col("size")) & (chunk == F.substring("near", F.lit(2), half)))


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents."""
    words = materialize(word_counts(docs, id_col=id_col, text_col=text_col), "spelling-words")
    return variants(words, factor=factor)


def variants(words: DataFrame, *, factor: int = FACTOR, key_rows: int = KEY_ROWS) -> DataFrame:
    """As spelling_variants, from distinct words with their counts (word, n)."""
    pairs = near_pairs(words, key_rows=key_rows)
    both = pairs.select(F.explode(F.array(
        F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min_by(F.struct("near", "near_n"), F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best"))
    form = F.when(F.col("best.near_n") >= factor * F.col("n"), F.col("best"))
    found = words.join(best, "word", "left").select("word", form["near"].alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form["near_n"].alias("form_n"))
    found = materialize(found, "spelling-forms")
    # Words without a form are roots; each round doubles the steps that the others have taken.
    at = found.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        at = materialize(at, "spelling-roots")
        next_ = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if at.join(next_, "root", "left_semi").isEmpty():
            break
        at = at.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return found.join(at, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
