import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voltrace.llm import cells, simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows):
    fps = {i: brute_fingerprint(t) for i, t in rows}
    comp = {i: i for i in fps}
    ids = sorted(fps)
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (fps[i] ^ fps[j]).bit_count() <= 3 and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return fps, comp


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("ab cde Fgh ij kl mno p q".split()) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    rows = list(enumerate(base)) + [(100 + i, t + " zz") for i, t in enumerate(base)] + [(300 + i, base[3]) for i in range(30)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "one two"), (405, "Ä É x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fps, comp = brute_components(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect()}
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def test_oversize_buckets_lose_nothing(spark):
    rng = np.random.default_rng(3)
    start = int(rng.integers(1 << 62))
    fps = {start}
    while len(fps) < 300:  # a family within a few bits
        fps.add(random.Random(len(fps)).choice(sorted(fps)) ^ (1 << int(rng.integers(63))))
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 200)}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    arr = np.array(sorted(fps), dtype=np.int64)
    near = np.bitwise_count(arr.view(np.uint64)[:, None] ^ arr.view(np.uint64)[None]) <= 3
    i, j = np.nonzero(np.triu(near, 1))
    want = cells.forest(len(arr), i, j)
    for cell_rows in (40, 4096):
        edges = simhash.links(df, 3, cell_rows)
        comp = {r.node: r.component for r in cells.connected_components(edges, "t").collect()}
        assert [comp.get(int(x), int(x)) for x in arr] == [int(arr[k]) for k in want]


def test_pivots_discard_only_pairs_that_cannot_link():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 10, 500).astype(np.int64)
    fps = np.unique(fps)
    table = np.array([[bin((int(f) ^ p) & (2**64 - 1)).count("1") for p in simhash.pivots()] for f in fps], dtype=np.int8)
    got = {tuple(sorted((int(a), int(b)))) for i, j in simhash.close_pairs(fps, table, 3) for a, b in zip(i, j)}
    want = {(i, j) for j in range(len(fps)) for i in range(j) if bin(int(fps[i] ^ fps[j])).count("1") <= 3}
    assert got == want


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, fp string, key int")
    assert simhash.simhash_components(empty).count() == 0
    rows = [(1, "a b c d", "x", 1), (1, "a b c d", "y", 2), (2, "a b c d", "z", 3), (None, "a b c d", "n", 4), (5, "q w e r t y", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, key int")
    assert sorted((r.doc_id or -1, r.component_id) for r in simhash.simhash_components(df).collect()) == [(-1, 1), (1, 1), (1, 1), (2, 1), (5, 5)]
    stay = simhash.first_of_each_group(df, simhash.simhash_components(df).select("doc_id", "component_id"))
    assert stay.columns == df.columns
    assert sorted((r.doc_id or -1) for r in stay.collect()) == [-1, 1, 5]


def brute_similar(rows, width=5, similarity=0.8):
    """Component ids by exact Jaccard similarity of shingle sets, over all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[k:k + width]) for k in range(max(1, len(w) - width + 1))}
    ids = sorted(sets)
    pairs = [(a, b) for b in range(len(ids)) for a in range(b) if len(sets[ids[a]] & sets[ids[b]]) >= similarity * len(sets[ids[a]] | sets[ids[b]])]
    label = cells.forest(len(ids), np.array([a for a, _ in pairs], dtype=int), np.array([b for _, b in pairs], dtype=int))
    return {ids[k]: ids[label[k]] for k in range(len(ids))}


@pytest.mark.parametrize("cell_rows", [8, 512])
def test_similar_groups_against_brute_force(spark, cell_rows):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(800)]
    rows, i = [], 0
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 300))]
        for _ in range(rng.randrange(1, 6)):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(text) // 40)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((i, " ".join(text)))
            i += 1
    rows += [(900 + k, rows[0][1]) for k in range(40)] + [(1000, None), (1001, ""), (1002, "one two"), (1003, "one  TWO"), (1004, rows[5][1] * 50)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, component int").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df, cell_rows=cell_rows).collect()}
    want = brute_similar(rows)
    assert got == want and len(set(want.values())) < len(want) - 60
    assert all(want[k] == want[c] for k, c in got.items())  # no link but exact ones
    assert simhash.similar_groups(df.limit(0)).count() == 0


def test_all_copies_at_the_threshold_are_found(spark):
    """Passages appended, so that the similarity is 0.8 or just above, to texts of 9 to 400 words that hardly repeat a word."""
    rng = random.Random(4)
    rows = []
    for length in (9, 16, 40, 120, 400):
        for _ in range(30):
            base = [f"w{rng.randrange(20_000)}" for _ in range(length)]
            added = [f"w{rng.randrange(20_000)}" for _ in range((length - 4) // 4)]
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base + added))]
    rows += [(len(rows) + k, " ".join(["the same words in all of these texts"] * k)) for k in range(1, 80)]  # common shingles only
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_similar(rows)
    assert all(want[i + 1] == i for i in range(0, 300, 2))
    for cell_rows in (8, 512):
        assert {r.doc_id: r.component_id for r in simhash.similar_groups(df, cell_rows=cell_rows).collect()} == want


def test_long_near_copies_are_cut_by_bytes(spark):
    """Texts of some 200,000 bytes each, whose chunks hold one or two of them."""
    rng = random.Random(12)
    rows = []
    for _ in range(3):
        base = [f"w{rng.randrange(50_000)}" for _ in range(30_000)]
        for _ in range(7):
            text = list(base)
            for _ in range(rng.randrange(0, 400)):
                text[rng.randrange(len(text))] = f"w{rng.randrange(50_000)}"
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_similar(rows)
    assert len(set(want.values())) == 3
    for cell_bytes in (1, 300_000, 32 << 20):
        assert {r.doc_id: r.component_id for r in simhash.similar_groups(df, cell_bytes=cell_bytes).collect()} == want


def test_cells_are_bounded_by_rows_and_by_size(spark):
    rows = [(k % 2, k, 1000 if k % 2 else 1) for k in range(400)] + [(2, 1000, 10**6)]
    df = spark.createDataFrame(rows, "key int, item long, bytes long")
    cut = cells.into_cells(df, "key", "item", 150, size=F.col("bytes"), cell_size=20_000)
    held = cut.groupBy("key", "cell_i", "cell_j").agg(F.count("item").alias("n"), F.sum("bytes").alias("bytes")).collect()
    chunks = {k: len({r.cell_i for r in held if r.key == k}) for k in range(3)}
    assert chunks == {0: 2, 1: 10, 2: 1}
    assert all(r.n < 2 * 150 and (r.bytes < 4 * 20_000 or r.n == 1) for r in held)


def test_texts_that_share_an_id_lose_none(spark):
    base = [" ".join(f"{w}{k}" for k in range(40)) for w in "abcd"]
    rows = [(1, base[0]), (1, base[1]), (2, base[0] + " z"), (1, base[0]), (3, base[2]), (4, base[2] + " z"), (3, base[3]), (5, base[1] + " z"), (None, base[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stay = simhash.first_of_each_group(df, simhash.similar_groups(df))
    want = [(-1, base[3]), (1, base[0]), (1, base[1]), (3, base[2]), (3, base[3])]
    assert sorted((r.doc_id or -1, r.text) for r in stay.collect()) == want


def test_prefixes_rule_out_only_what_is_not_similar():
    rng = random.Random(8)
    common = (np.array(sorted(rng.randrange(1 << 64) for _ in range(200)), dtype=np.uint64), np.arange(3, 203))
    pool = [rng.randrange(1 << 64) for _ in range(2000)] + common[0].tolist()
    ruled_out = 0
    for _ in range(2000):
        a = rng.sample(pool, rng.randrange(1, 120))
        b = frozenset(rng.sample(a, rng.randrange(len(a) * 3 // 4, len(a) + 1)) + rng.sample(pool, rng.randrange(0, 1 + len(a) // 4)) or a)
        a = frozenset(a)
        similar = len(a & b) >= 0.8 * len(a | b)
        x, y = simhash.prefix(a, 0.8, common), simhash.prefix(b, 0.8, common)
        met = len(np.intersect1d(x, y)) > 0 and simhash.may_be_similar(simhash.brief(x), simhash.brief(y), len(a), len(b), 0.8)
        assert met or not similar
        ruled_out += not met
    assert ruled_out > 0
