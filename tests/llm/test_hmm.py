"""The forward recursion and Baum-Welch counts against sums over all paths."""

import itertools
import math

import numpy as np
import pytest

from vellumix.llm import hmm


def brute(model, sym):
    """Likelihood, and expected counts, from every path of states."""
    s, n = len(model.initial), len(model.emission)
    total, first, pairs, emitted = 0.0, np.zeros(s), np.zeros((s, s)), np.zeros((n, s))
    for path in itertools.product(range(s), repeat=len(sym)):
        p = model.initial[path[0]] * model.emission[sym[0], path[0]]
        for a, b, o in zip(path, path[1:], sym[1:]):
            p *= model.transition[a, b] * model.emission[o, b]
        total += p
        first[path[0]] += p
        for a, b in zip(path, path[1:]):
            pairs[a, b] += p
        for a, o in zip(path, sym):
            emitted[o, a] += p
    return total, first / total, pairs / total, emitted / total


def test_sweep_equals_all_paths():
    r = np.random.default_rng(1)
    model = hmm.start_model(r.dirichlet(np.ones(6)), 3)
    sents = [r.integers(0, 6, k) for k in (4, 1, 6, 2, 6, 3)]
    sweep = hmm.Sweep(np.concatenate(sents).astype(np.uint16), np.array([len(x) for x in sents]), model)
    want = [brute(model, x) for x in sents]
    assert np.allclose(sweep.log_likelihood(), [math.log(w[0]) for w in want])
    for got, k in zip(sweep.counts(), (1, 2, 3)):
        assert np.allclose(got, sum(w[k] for w in want))


def test_long_sequences_do_not_underflow():
    model = hmm.start_model(np.full(50, 0.02), 4)
    sym = np.random.default_rng(2).integers(0, 50, 30_000).astype(np.uint16)
    assert abs(hmm.Sweep(sym, np.array([30_000]), model).log_likelihood()[0] / 30_000 - math.log(0.02)) < 0.2


def turns():
    r = np.random.default_rng(3)
    words = [["sun", "moon", "star"], ["runs", "sits", "falls"]]
    return [". ".join(" ".join(words[(i + k) % 2][r.integers(3)] for i in range(6)) for k in range(r.integers(1, 5))) for _ in range(80)]


def test_each_step_raises_the_likelihood(docs, monkeypatch):
    monkeypatch.setattr(hmm, "SAMPLE_STEPS", 0)
    monkeypatch.setattr(hmm, "SAMPLE_WORDS", 60)  # a start from which there is something to learn
    text = turns()
    df = docs(list(enumerate(text))).repartition(3)
    total = sum(len(t.replace(".", "").split()) for t in text)
    model = hmm.train(df, hmm.blocks(df), 2, 1e-5)
    seen = [g * total * math.log(2) for g in model.gains]
    assert all(b >= a - 1e-4 * abs(a) for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0] + 10, seen
    assert math.isclose(model.occupied.sum(), total + hmm.PRIOR * 2 + hmm.WORD_PRIOR * 6, rel_tol=1e-4) and model.words.count() == 1


def test_a_distributed_step_equals_one_over_all_sentences(docs, monkeypatch):
    """From the same model, counts by blocks and buckets are those of a sweep on one machine, in the precision in which they travel."""
    for name, k in (("BLOCK_WORDS", 300), ("CHUNK_WORDS", 64), ("COUNT_WORDS", 100), ("BUCKET_WORDS", 2)):
        monkeypatch.setattr(hmm, name, k)
    text = turns() + ["sun runs moon", "", None, "star " * 500]
    df = docs(list(enumerate(text))).repartition(3)
    coded = hmm.blocks(df)
    model = hmm.train(df, coded, 2, 1e9)  # two steps
    sents = [x.split() for t in text if t for x in t.split(". ")]
    names = sorted({w for x in sents for w in x})
    sym = np.array([names.index(w) for x in sents for w in x])
    hashes = hmm._words(hmm.pa.array(names), hmm.WordHasher())[1]
    rows = model.words.collect()
    c = dict(zip(np.concatenate([np.frombuffer(r.h, np.uint64) for r in rows]).tolist(), np.concatenate([np.frombuffer(r.c, np.float64).reshape(-1, 2) for r in rows])))
    emission = np.array([c[h] for h in hashes.tolist()]) / model.occupied
    sweep = hmm.Sweep(sym, np.array([len(x) for x in sents]), hmm.Model(model.initial, model.transition, emission))
    found = hmm.emissions(coded, model, False).groupBy("block").cogroup(coded.select("block", "vocab", "place", "symbols", "alive", "steps").groupBy("block"))
    found = found.applyInArrow(hmm._count_block(model.initial, model.transition, model.occupied, model.bits), "bucket int, h binary, c binary, sums array<double>").collect()
    got = {}
    for r in found:
        for h, x in zip(np.frombuffer(r.h, np.uint64).tolist(), hmm._unpacked(r.c, 2)):
            got[h] = got.get(h, 0) + x
    first, pairs, emitted = sweep.counts()
    assert np.allclose([got[h] for h in hashes.tolist()], emitted, rtol=5e-3, atol=5e-2)
    sums = np.sum([r.sums for r in found if r.sums], axis=0)
    assert np.allclose(sums[:2], first, rtol=5e-3, atol=5e-2) and np.allclose(sums[2:6].reshape(2, 2), pairs, rtol=5e-3, atol=5e-2)
    assert math.isclose(sums[6], sweep.log_likelihood().sum(), rel_tol=1e-4)
    want = sum(sweep.log_likelihood())
    assert math.isclose(hmm.score_blocks(coded, model).agg({"log_likelihood": "sum"}).first()[0], want, rel_tol=1e-5)


def test_scores_of_cases(docs):
    rows = [(1, "The cat sat. The cat ran!"), (2, None), (3, ""), (4, "?! ..."), (None, "The cat sat."), (1, "The cat sat. The cat ran!"), (5, "zebra " * 30_000), (6, "The dog\nsat")]
    df = docs(rows).selectExpr("*", "1 AS h", "2 AS n", "3 AS k", "4 AS n_words")
    got = hmm.score(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows) and len(by[1]) == 2 and by[1][0] == by[1][1]
    assert by[1][0].n_words == 6 and by[1][0].n_sentences == 2 and by[6][0].n_sentences == 2 and by[5][0].n_words == 30_000
    for i in (2, 3, 4):
        assert (by[i][0].n_words, by[i][0].log_likelihood, by[i][0].bits_per_word) == (0, 0.0, None)
    assert by[None][0].log_likelihood == pytest.approx(by[None][0].bits_per_word * -3 * math.log(2))
    assert hmm.score(df.limit(0)).count() == 0 and hmm.score(df.filter("text IS NULL")).first().n_words == 0


def grammar(n, seed, words=3000):
    """Sentences of two kinds of words in turn; most words are rare."""
    r = np.random.default_rng(seed)
    kinds = [[f"{c}{k}" for k in range(words)] for c in "ab"]
    share = 1 / np.arange(1, words + 1)
    pick = [r.choice(words, 12 * n, p=share / share.sum()) for _ in kinds]
    return [" ".join(kinds[(j + i) % 2][pick[(j + i) % 2][12 * i + j]] for j in range(12)) for i in range(n)]


def test_training_beats_the_unigram_on_held_out_text(docs):
    train, held = grammar(3000, 4), grammar(300, 5)
    df, other = docs(list(enumerate(train))).repartition(3), docs(list(enumerate(held)))
    model = hmm.train(df, hmm.blocks(df))
    counts = {}
    for w in " ".join(train).split():
        counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    unigram = -np.mean([math.log2(counts.get(w, 1) / total) for w in " ".join(held).split()])
    got = hmm.score_blocks(hmm.blocks(other), model).selectExpr("-sum(log_likelihood) / sum(n_words) / ln(2)").first()[0]
    assert got < unigram - 0.5
    assert model.gains[-1] - model.gains[-2] < hmm.TOLERANCE and all(b > a - 1e-2 for a, b in zip(model.gains, model.gains[1:]))


def test_every_word_has_its_own_emission(docs, monkeypatch):
    monkeypatch.setattr(hmm, "BUCKET_WORDS", 64)  # many buckets
    text = grammar(2000, 6)
    df = docs(list(enumerate(text))).repartition(3)
    model = hmm.train(df, hmm.blocks(df))
    rows = model.words.collect()
    h = np.concatenate([np.frombuffer(r.h, np.uint64) for r in rows])
    c = np.concatenate([np.frombuffer(r.c, np.float64).reshape(-1, hmm.STATES) for r in rows])
    assert len(rows) > 16 and len(set(h.tolist())) == len(h) == len(set(" ".join(text).split()))
    assert np.allclose((c / model.occupied).sum(axis=0), 1)  # likelihoods are of words
    assert math.isclose(c.sum(), 12 * len(text) + hmm.PRIOR * hmm.STATES + hmm.WORD_PRIOR * len(h), rel_tol=1e-4)


def test_made_up_words_score_below_known_ones(docs):
    text = [". ".join(grammar(40, k, 50)) for k in range(30)]
    junk = " ".join(f"q{k:07d}" for k in range(480))  # each word once
    got = {r.doc_id: r.bits_per_word for r in hmm.score(docs([*enumerate(text), (99, junk)])).collect()}
    assert got[99] > max(v for k, v in got.items() if k != 99)
