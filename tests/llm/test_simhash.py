"""Near duplicates against all pairs of fingerprints."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vellumix.llm import simhash as s
from vellumix.llm.words import WordHasher


def corpus(n=400, seed=3):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.4:
            words = r.choice(rows).split()
            for _ in range(int(len(words) * r.choice([0, 0.01, 0.03, 0.06]))):
                words[r.randrange(len(words))] = r.choice(vocab)
        else:
            words = [r.choice(vocab) for _ in range(r.randint(40, 300))]
        rows.append(" ".join(words))
    return rows


def groups(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def all_pairs(texts):
    n, f = s.fingerprint_arrays(pa.array(texts), WordHasher())
    err = np.bitwise_count(f[:, None, :] ^ f[None, :, :]).sum(axis=2)
    near = (err <= s.BUDGET) & (np.minimum(n[:, None], n[None]) >= s.LENGTH_RATIO * np.maximum(n[:, None], n[None]))
    return n, f, [(a, b) for a, b in zip(*np.nonzero(near)) if a < b]


def test_trie_join_equals_all_pairs():
    texts = corpus()
    n, f, pairs = all_pairs(texts)
    label = s.trie_self_join(np.zeros(len(f), np.int64), f, n, 0)
    assert label.tolist() == groups(pairs, len(texts))


def test_recall_and_precision(docs):
    texts = corpus(1500)
    _, _, pairs = all_pairs(texts)
    root = groups(pairs, len(texts))
    got = {r.doc_id: r.duplicate_of for r in s.near_duplicates(docs(list(enumerate(texts)))).collect()}
    mine = [got.get(i, i) for i in range(len(texts))]
    assert np.mean([mine[a] == mine[b] for a, b in pairs]) >= 0.95
    assert all(root[i] == root[j] for i, j in got.items())


def far_copies(n=500, seed=12):
    """Texts and copies with so many words changed that their fingerprints differ in about as many bits as the budget."""
    r = random.Random(seed)
    words = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    rows = []
    for _ in range(n):
        text = words(r.randint(60, 250))
        for _ in range(2):
            copy = list(text)
            for k in r.sample(range(len(copy)), int(len(copy) * r.uniform(0.04, 0.07))):
                copy[k] = words(1)[0]
            rows.append(" ".join(copy))
    return rows


def test_no_pair_within_the_budget_is_left_out(docs):
    """Pairs that use up nearly the whole budget, too: the groups are those of all pairs."""
    texts = far_copies()
    _, f, pairs = all_pairs(texts)
    assert sum(np.bitwise_count(f[a] ^ f[b]).sum() > s.BUDGET - 4 for a, b in pairs) >= 50
    got = {r.doc_id: r.duplicate_of for r in s.near_duplicates(docs(list(enumerate(texts)))).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == groups(pairs, len(texts))


def test_cells_of_a_band_are_all_paired(docs, monkeypatch):
    monkeypatch.setattr(s, "CELL", 60)
    texts = corpus(600)
    _, _, pairs = all_pairs(texts)
    got = {r.doc_id: r.duplicate_of for r in s.near_duplicates(docs(list(enumerate(texts)))).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == groups(pairs, len(texts))


def test_tries_equal_all_pairs_within_and_across(monkeypatch):
    n, f, pairs = all_pairs(far_copies(400) + corpus(300))
    side = np.random.default_rng(1).integers(0, 2, len(f)).astype(np.int8)
    for across in (False, True):
        want = groups([(a, b) for a, b in pairs if not across or side[a] != side[b]], len(f))
        for limit in (1 << 30, 0):  # all pairs, then tries
            monkeypatch.setattr(s, "DENSE_PAIRS", limit)
            assert groups(s.near_pairs(side if across else side * 0, f, n, across).tolist(), len(f)) == want


def test_cases(docs):
    a = "one two three four five six seven eight nine ten " * 3
    rows = [(5, a), (3, a), (9, a.upper()), (7, None), (8, ""), (10, "?! ..."), (None, a), (3, a), (11, "word " * 40_000), (12, "word " * 40_000)]
    df = docs(rows).selectExpr("*", "1 AS leaf", "2 AS root", "3 AS f0")
    assert {r.doc_id: r.duplicate_of for r in s.near_duplicates(df).collect()} == {5: 3, 9: 3, 12: 11}
    left = s.deduplicate(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or 0 for r in left.collect())) == [0, 3, 7, 8, 10, 11]
    assert s.near_duplicates(df.limit(0)).count() == 0 and s.deduplicate(df.limit(0)).count() == 0


def test_rows_of_one_doc_id_and_text(docs):
    """Rows that differ only in other columns: the same one stays, whatever their order."""
    text = "one two three four five six seven"
    rows = [(1, text, lang, src) for lang in ("en", "fr", None) for src in ("a", "b")] + [(1, "short one here"), (None, text), (None, text)]
    kept = {tuple(sorted(map(str, s.deduplicate(docs(r).repartition(n)).collect()))) for r in (rows, rows[::-1]) for n in (1, 3)}
    assert len(kept) == 1 and len(next(iter(kept))) == 3
    assert s.deduplicate(docs(rows).withColumn("m", F.create_map(F.lit("k"), "source"))).count() == 3


def test_components_of_a_hub_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, 0)]
    got = {r.node: r.root for r in s.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 400)} | {1001 + i: 1000 for i in range(60)}


def test_every_set_of_bits_within_the_budget_passes_some_ring():
    r = np.random.default_rng(8)
    rings = s.rings(s.BUDGET)
    assert all(len(most) == s.BITS + 1 and most[-1] == s.BUDGET for _, most in rings)
    spread = np.arange(s.BUDGET) * s.BITS // s.BUDGET
    runs = [np.arange(s.BUDGET) + k for k in range(0, s.BITS, 5)]
    for at in [r.permutation(s.BITS)[: s.BUDGET] for _ in range(2000)] + [spread + k for k in range(7)] + runs:
        bits = np.zeros(s.BITS, int)
        bits[at % s.BITS] = 1
        assert any((np.cumsum(np.roll(bits, -start)) <= most[1:]).all() for start, most in rings)


def test_rotation_begins_with_the_bit():
    f = np.random.default_rng(9).integers(0, 1 << 64, (50, 4), dtype=np.uint64)
    bits = np.unpackbits(f.astype(">u8").view(np.uint8), axis=1)
    for start in (0, 1, 63, 64, 100, 255):
        assert (np.unpackbits(s.rotated(f, start).astype(">u8").view(np.uint8), axis=1) == np.roll(bits, -start, axis=1)).all()


def test_counts_within_the_ratio_are_one_band_apart_at_most():
    low = np.concatenate((np.arange(1, 200_000), np.random.default_rng(2).integers(1, 1 << 30, 100_000)))
    assert (s.band_of(np.floor(low / s.LENGTH_RATIO + 1e-6)) - s.band_of(low) <= 1).all()


def test_votes_of_long_texts_are_counted_whole_and_in_little_memory():
    """Counts beyond one byte, against plain addition; the votes of a piece never stand in memory as whole numbers."""
    texts = [" ".join(f"w{i * k % 4001}" for i in range(m)) for k, m in ((1, 1), (3, 254), (5, 255), (7, 256), (11, 511), (13, 4000))] + [""]
    n, f = s.fingerprint_arrays(pa.array(texts), WordHasher())
    for text, count, print_ in zip(texts, n, f):
        _, h = WordHasher()(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        low = np.unique(h >> np.uint64(16))
        want = [sum(1 << b for b in range(64) if 2 * int(((s.mix(low * seed + seed) >> np.uint64(b)) & np.uint64(1)).sum()) > len(low)) for seed in s.SEEDS]
        assert count == len(h) and print_.tolist() == want
    many = pa.array([" ".join(f"w{i}x{k}" for i in range(1500)) for k in range(100)])
    tracemalloc.start()
    s.fingerprint_arrays(many, WordHasher())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 800 * 150_000  # bytes a word
