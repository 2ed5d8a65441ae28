"""Language-model scores of a hidden Markov model that is trained on the corpus.

A sequence is a sentence: the words between two of . ! ? ; | or line ends. Its symbols are the words in lower case, every distinct word of the
corpus for itself. The emission table is a distributed table of buckets of word hashes; it is never collected or shipped. Documents stand in blocks
with the block's distinct words, its sentences side by side in the order in which the recursions read them. Each Baum-Welch step asks the
buckets for the emissions of every block's words, runs the E-step block by block, and sums the expected counts by word. The first model comes from
a sample of sentences, trained on the driver from a start without symmetry; that is only where training begins: steps over all sentences of
all documents follow until one gains less than TOLERANCE bits a word. The scaled forward recursion then gives every sentence's exact log-likelihood, and
a document's is the sum over its sentences.

Defined results. A null or empty text, or one without words, has n_words 0, log_likelihood 0 and no bits_per_word. Texts of any
length are trained on and scored whole. Repeated rows count and are scored each for itself, a null doc_id is kept. Ties don't arise. Only doc_id and
text are read. An empty table, or one without words, gives no model and no scores but the zeros above. In training, states' shares of a word travel in half
precision, and emissions in single precision in scoring; sums depend on their order, so scores agree from run to run to about 4 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, pieces, table, text_of, tidy, utf8
from .words import WordHasher, mix

STATES, SEED = 8, 11
PIECE_BYTES, CHUNK_WORDS, COUNT_WORDS = 1 << 20, 1 << 17, 1 << 20
BLOCK_WORDS, BLOCK_ROWS, BUCKET_WORDS = 1 << 22, 1 << 19, 1 << 18
TOLERANCE, SAMPLE_WORDS, SAMPLE_STEPS, SUM_GROUPS = 0.005, 1 << 18, 20, 64
PRIOR = 1.0  # words' worth of the corpus's own word shares, added to each state's counts
WORD_PRIOR = 0.5  # added to each word's counts, in the states' proportions, so that words seen once aren't tied to one state
BREAK = np.zeros(256, bool)
BREAK[list(b".!?;|\n\r")] = True


@dataclass
class Model:
    initial: np.ndarray  # S
    transition: np.ndarray  # S x S
    emission: np.ndarray  # symbols x S


def _words(texts: pa.Array, hasher: WordHasher):
    """Text, hash, length and sentence of every word."""
    raw, at = utf8(pc.utf8_lower(texts))
    start, stop, h = hasher.spans(raw, at)
    doc = np.searchsorted(at, start, side="right") - 1
    breaks = np.concatenate(([0], np.cumsum(BREAK[raw])))[start] if len(start) else start
    return doc, h, stop - start, breaks


# the recursions


def lanes(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentences side by side, the longest first: their order, how many are left at each word, and the place of every word, by word and then by sentence."""
    order = np.argsort(-size, kind="stable")
    length, start = size[order], (np.cumsum(size) - size)[order]
    steps = int(length[0]) if len(length) else 0
    alive = len(length) - np.searchsorted(length[::-1], np.arange(steps), side="right")
    offset = np.concatenate(([0], np.cumsum(alive)))
    row = np.arange(offset[-1]) - np.repeat(offset[:-1], alive)
    return order, alive, start[row] + np.repeat(np.arange(steps), alive)


class Lanes:
    """The forward recursion, and the backward one, over sentences side by side. emission: states x symbols."""

    def __init__(self, sym: np.ndarray, alive: np.ndarray, initial: np.ndarray, transition: np.ndarray, emission: np.ndarray) -> None:
        self.sym, self.alive, self.move = sym, alive, transition.astype(emission.dtype)
        self.emit = np.take(emission, sym, axis=1)
        self.alpha, self.scale = np.empty_like(self.emit), np.empty(len(sym), emission.dtype)
        a, lo, back = initial[:, None].astype(emission.dtype), 0, np.ascontiguousarray(self.move.T)
        for t, k in enumerate(alive.tolist()):
            hi = lo + k
            a = (back @ a[:, :k] if t else a) * self.emit[:, lo:hi]
            c = a.sum(axis=0)
            a /= c
            self.alpha[:, lo:hi], self.scale[lo:hi] = a, c
            lo = hi

    def log_likelihood(self) -> np.ndarray:
        """Of every sentence, the longest first."""
        n = int(self.alive[0]) if len(self.alive) else 0
        row = np.arange(len(self.sym)) - np.repeat(np.cumsum(self.alive) - self.alive, self.alive)
        return np.bincount(row, np.log(self.scale, dtype=float), minlength=n)

    def gammas(self, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every word's state probabilities, into out (states x words); expected counts of initial states and of transitions."""
        s, edge = len(self.move), np.concatenate(([0], np.cumsum(self.alive))).tolist()
        pairs, beta, ahead = np.zeros((s, s)), None, self.emit
        ahead /= self.scale
        for t in range(len(self.alive) - 1, -1, -1):
            lo, hi = edge[t], edge[t + 1]
            now = np.ones((s, hi - lo), ahead.dtype)
            if beta is not None:
                k = beta.shape[1]
                b = ahead[:, hi : hi + k] * beta
                pairs += self.alpha[:, lo : lo + k] @ b.T
                now[:, :k] = self.move @ b
            np.multiply(self.alpha[:, lo:hi], now, out=out[:, lo:hi])
            beta = now
        first = out[:, : self.alive[0]].sum(axis=1, dtype=float) if len(self.alive) else np.zeros(s)
        return first, pairs * self.move


class Sweep:
    """A model's recursions over sentences given one after another."""

    def __init__(self, sym: np.ndarray, size: np.ndarray, model: Model) -> None:
        self.order, alive, at = lanes(size)
        self.n = len(model.emission)
        self.lanes = Lanes(sym[at], alive, model.initial, model.transition, np.ascontiguousarray(model.emission.T))

    def log_likelihood(self) -> np.ndarray:
        """Of every sentence, in the order given."""
        out = np.zeros(len(self.order))
        out[self.order] = self.lanes.log_likelihood()
        return out

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of initial states, transitions, and emissions."""
        gamma = np.empty_like(self.lanes.alpha)
        first, pairs = self.lanes.gammas(gamma)
        return first, pairs, _by_symbol(self.lanes.sym, gamma, self.n)


def _by_symbol(sym: np.ndarray, gamma: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(sym, g, minlength=n) for g in gamma], axis=1)


def start_model(shares: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
    """States that differ a little, around the corpus's word shares."""
    r = np.random.default_rng(seed)
    emission = shares[:, None] * r.uniform(0.5, 1.5, (len(shares), states))
    transition = r.uniform(0.5, 1.5, (states, states))
    return Model(np.full(states, 1 / states), transition / transition.sum(axis=1, keepdims=True), emission / emission.sum(axis=0))


def next_model(first: np.ndarray, pairs: np.ndarray, emitted: np.ndarray, shares: np.ndarray) -> Model:
    """The M-step; a little of the word shares keeps every symbol possible in every state."""
    first, pairs = first + 1e-3, pairs + 1e-3
    emitted = emitted + PRIOR * shares[:, None]
    return Model(first / first.sum(), pairs / pairs.sum(axis=1, keepdims=True), emitted / emitted.sum(axis=0))


# blocks of documents

#: rows: words and sentences of each document; vocab: sorted hashes; place: in vocab, of the block's words from the most frequent on; symbols: numbers in
#: that order as three planes of bytes, which compress well; alive, steps: the lanes of each chunk of sentences; sentence: which one each lane is.
BLOCK = "block long, ids array<long>, words binary, sentences binary, n_vocab long, n_words long, vocab binary, place binary, symbols binary, alive binary, steps binary, sentence binary"
WORDS = "bucket int, h binary, n binary, c binary, total array<double>"
SCORES = "doc_id long, n_words int, n_sentences int, log_likelihood double, bits_per_word double"


def _planes(x: np.ndarray) -> bytes:
    raw = x.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.ascontiguousarray(raw[:, :3].T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    a, b, c = np.frombuffer(raw, np.uint8).reshape(3, -1).astype(np.int32)
    return a | b << 8 | c << 16


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, number, held, n_words, n_rows = WordHasher(), TaskContext.get().partitionId() << 32, [], 0, 0

    def block() -> pa.RecordBatch:
        ids = pa.concat_arrays([x[0] for x in held])
        words, sentences, h, size = (np.concatenate(x) for x in list(zip(*held))[1:])
        vocab, sym, count = np.unique(h, return_inverse=True, return_counts=True)
        place = np.argsort(-count, kind="stable")
        rank = np.empty(len(vocab), np.int32)
        rank[place] = np.arange(len(vocab))
        sym = rank[sym]
        order = np.argsort(-size, kind="stable")
        size, start = size[order], (np.cumsum(size) - size)[order]
        total, lo, alive, steps, at = np.cumsum(size), 0, [], [], []
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CHUNK_WORDS, side="right")))
            _, left, _ = lanes(size[lo:hi])
            edge = np.cumsum(left) - left
            lane = np.arange(left.sum()) - np.repeat(edge, left)
            at.append(start[lo:hi][lane] + np.repeat(np.arange(len(left)), left))
            alive.append(left)
            steps.append(len(left))
            lo = hi
        joined = lambda x: np.concatenate(x).astype(np.uint32) if x else np.zeros(0, np.uint32)
        cols = [vocab, place.astype(np.uint32), _planes(sym[joined(at)]), joined(alive), np.array(steps, np.uint32), order.astype(np.uint32)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number]),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                *(pa.array([x.astype(np.uint32).tobytes()]) for x in (words, sentences)),
                pa.array([len(vocab)], pa.int64()),
                pa.array([len(h)], pa.int64()),
                *(pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in cols),
            ],
            ["block", "ids", "words", "sentences", "n_vocab", "n_words", "vocab", "place", "symbols", "alive", "steps", "sentence"],
        )

    for batch in batches:
        for part in pieces(batch, PIECE_BYTES):
            doc, h, _, breaks = _words(text_of(part), hasher)
            first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (breaks[1:] != breaks[:-1])))) if len(doc) else doc
            held.append((part.column(0), np.bincount(doc, minlength=part.num_rows), np.bincount(doc[first], minlength=part.num_rows), h, np.diff(np.append(first, len(doc)))))
            n_words, n_rows = n_words + len(h), n_rows + part.num_rows
            if n_words >= BLOCK_WORDS or n_rows >= BLOCK_ROWS:
                yield block()
                number, held, n_words, n_rows = number + 1, [], 0, 0
    if held:
        yield block()


def blocks(docs: DataFrame) -> DataFrame:
    """All rows in blocks: their words as places in the block's distinct words, sentence beside sentence."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(_block_batches, BLOCK), "zstd")


def _chunks(block: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols and lanes of each chunk of a block's sentences."""
    sym, alive, lo, step = _from_planes(block["symbols"][0].as_py()), _binary(block, "alive", np.uint32)[0].astype(np.int64), 0, 0
    for n in _binary(block, "steps", np.uint32)[0].tolist():
        left = alive[step : step + n]
        hi = lo + int(left.sum())
        yield sym[lo:hi], left
        lo, step = hi, step + n


# buckets of words


@dataclass
class Trained:
    words: DataFrame  # bucket; sorted hashes, corpus counts and expected counts by state of its words
    bits: int  # a word's bucket is this many first bits of its hash
    initial: np.ndarray
    transition: np.ndarray
    occupied: np.ndarray  # sum of the expected counts by state
    gains: list[float]  # log-likelihood, in bits a word, of the corpus before each step


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32)


def _binary(t: pa.Table, name: str, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype) for x in t[name]]


def _packed(c: np.ndarray) -> bytes:
    """Counts by state: their sum in single, the states' shares in half precision."""
    total = c.sum(axis=1)
    return total.astype(np.float32).tobytes() + (c / np.maximum(total, 1e-30)[:, None]).astype(np.float16).tobytes()


def _unpacked(raw: bytes, states: int) -> np.ndarray:
    n = len(raw) // (4 + 2 * states)
    return np.frombuffer(raw, np.float32, n)[:, None] * np.frombuffer(raw, np.float16, offset=4 * n).reshape(n, states).astype(np.float32)


def _word_row(bucket: int, h: np.ndarray, n: np.ndarray, c: np.ndarray) -> pa.Table:
    c = c.astype(np.float32).astype(float)  # what is below single precision only takes room
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "h": [h.tobytes()], "n": [n.tobytes()], "c": [c.tobytes()], "total": pa.array([c.sum(axis=0)], pa.list_(pa.float64()))})


def _by_bucket(h: np.ndarray, bits: int) -> tuple[np.ndarray, list[slice]]:
    """The buckets of sorted hashes, and where each one's are."""
    bucket = _bucket(h, bits)
    begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(h) else np.zeros(0, np.int64)
    edge = np.append(begin, len(h)).tolist()
    return bucket[begin], [slice(a, b) for a, b in zip(edge, edge[1:])]


def _totals(words: DataFrame, states: int) -> np.ndarray:
    rows = words.filter("bucket >= 0").select(F.posexplode("total").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(states)
    out[[r.k for r in rows]] = [r.x for r in rows]
    return out


def _sample_batches(share: float):
    """Sentences chosen at random: hashes of their words, and how many words each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = pa.Table.from_batches([batch.slice(k, 1)])
                vocab, place, r = _binary(block, "vocab", np.uint64)[0], _binary(block, "place", np.uint32)[0], np.random.default_rng((SEED, block["block"][0].as_py()))
                for sym, alive in _chunks(block):
                    lane = np.flatnonzero(r.random(int(alive[0])) < share)
                    size = len(alive) - np.searchsorted(alive[::-1], lane, side="right")
                    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    at = (np.cumsum(alive) - alive)[step] + np.repeat(lane, size)
                    yield pa.RecordBatch.from_arrays([pa.array([vocab[place[sym[at]]].tobytes()]), pa.array([size.astype(np.int64).tobytes()])], ["h", "size"])

    return run


def _sample_model(coded: DataFrame, total: int, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where training starts: hashes and state shares of a sample's words, initial states and transitions. Some SAMPLE_WORDS words, so that it fits the driver."""
    rows = coded.select("block", "vocab", "place", "symbols", "alive", "steps").mapInArrow(_sample_batches(SAMPLE_WORDS / total), "h binary, size binary").toArrow()
    h, size = (np.concatenate([np.zeros(0, d), *_binary(rows, c, d)]) for c, d in (("h", np.uint64), ("size", np.int64)))
    vocab, sym = np.unique(h, return_inverse=True)
    r = np.random.default_rng(SEED)
    transition = r.dirichlet(np.ones(states), states)
    if not len(h):
        return vocab, np.zeros((0, states)), np.full(states, 1 / states), transition
    shares = np.bincount(sym) / len(sym)
    x = np.stack([(mix(vocab + np.uint64(k)) >> np.uint64(40)).astype(float) / (1 << 24) for k in range(states)], axis=1)
    emission = shares[:, None] * (x + 1e-3) ** 2  # far from symmetric, so that training doesn't begin on a plateau
    model, before, step = Model(np.full(states, 1 / states), transition, emission / emission.sum(axis=0)), -np.inf, 0
    while True:
        sweep = Sweep(sym, size, model)
        now = sweep.log_likelihood().sum() / np.log(2) / len(sym)
        counts = sweep.counts()
        model = next_model(*counts, shares)
        if step >= SAMPLE_STEPS and now - before < TOLERANCE:
            emitted = counts[2] + WORD_PRIOR * counts[2].sum(axis=0) / len(sym)
            return vocab, emitted / emitted.sum(axis=1, keepdims=True), model.initial, model.transition
        before, step = now, step + 1


def _frequency_batches(bits: int):
    """By bucket, hashes and numbers of a block's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = pa.Table.from_batches([batch.slice(k, 1)])
                h, place = _binary(block, "vocab", np.uint64)[0], _binary(block, "place", np.uint32)[0]
                n = np.empty(len(h), np.int64)
                n[place] = np.bincount(_from_planes(block["symbols"][0].as_py()), minlength=len(h))
                buckets, where = _by_bucket(h, bits)
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), *(pa.array([x[w].tobytes() for w in where], pa.binary()) for x in (h, n))], ["bucket", "h", "n"])

    return run


def _first_words(bits: int, vocab: np.ndarray, share: np.ndarray, states: int):
    other = share.mean(axis=0) if len(share) else np.full(states, 1 / states)

    def run(t: pa.Table) -> pa.Table:
        h, sym = np.unique(np.concatenate(_binary(t, "h", np.uint64)), return_inverse=True)
        n = np.bincount(sym, np.concatenate(_binary(t, "n", np.int64)), minlength=len(h)).astype(np.int64)
        at = np.minimum(np.searchsorted(vocab, h), max(0, len(vocab) - 1))
        part = np.tile(other, (len(h), 1))
        if len(vocab):
            known = vocab[at] == h
            part[known] = share[at[known]]
        return _word_row(int(_bucket(h[:1], bits)[0]), h, n, n[:, None] * part)

    return run


def _ask_batches(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = np.frombuffer(raw, np.uint64)
                buckets, where = _by_bucket(h, bits)
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([number] * len(where), pa.int64()), pa.array([h[w].tobytes() for w in where], pa.binary())], ["bucket", "block", "h"])

    return run


def _answer(occupied: np.ndarray, fine: bool):
    s = len(occupied)

    def run(asked: pa.Table, words: pa.Table) -> pa.Table:
        h = _binary(words, "h", np.uint64)[0] if words.num_rows else np.zeros(0, np.uint64)
        c = _binary(words, "c", np.float64)[0].reshape(-1, s) if words.num_rows else np.zeros((0, s))
        out = []
        for want in _binary(asked, "h", np.uint64):
            at = np.minimum(np.searchsorted(h, want), max(0, len(h) - 1))
            known = h[at] == want if len(h) else np.zeros(len(want), bool)
            got = np.tile(WORD_PRIOR * occupied / occupied.sum(), (len(want), 1))  # a word that training didn't see
            got[known] = c[at[known]]
            out.append((got / occupied).astype(np.float32).tobytes() if fine else _packed(got))
        return pa.table({"block": asked["block"], "bucket": asked["bucket"], "e": pa.array(out, pa.binary())})

    return run


def emissions(coded: DataFrame, model: Trained, fine: bool) -> DataFrame:
    """block, bucket and, in the order of the block's hashes, the emissions of its words, or as packed counts."""
    asked = coded.select("block", "vocab").mapInArrow(_ask_batches(model.bits), "bucket int, block long, h binary")
    words = model.words.select("bucket", "h", "c").filter("bucket >= 0")
    return asked.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(_answer(model.occupied, fine), "block long, bucket int, e binary")


def _emission(answers: pa.Table, block: pa.Table, occupied: np.ndarray, fine: bool) -> np.ndarray:
    """States x symbols of a block, in single precision."""
    s, order = len(occupied), np.argsort(answers["bucket"].to_numpy())
    parts = [answers["e"][int(k)].as_py() for k in order]
    rows = [np.frombuffer(x, np.float32).reshape(-1, s) if fine else _unpacked(x, s) / occupied.astype(np.float32) for x in parts]
    every = np.concatenate(rows) if rows else np.zeros((0, s), np.float32)
    return np.ascontiguousarray(every[_binary(block, "place", np.uint32)[0]].T)


def _count_block(initial: np.ndarray, transition: np.ndarray, occupied: np.ndarray, bits: int):
    s = len(initial)

    def run(answers: pa.Table, block: pa.Table) -> pa.Table:
        h, place = _binary(block, "vocab", np.uint64)[0], _binary(block, "place", np.uint32)[0]
        emission = _emission(answers, block, occupied, False)
        first, pairs, emitted, ll = np.zeros(s), np.zeros((s, s)), np.zeros((len(h), s)), 0.0
        held, room = [], 0

        def settle() -> None:
            nonlocal emitted, held, room
            if held:
                emitted += _by_symbol(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held], axis=1), len(h))
            held, room = [], 0

        for sym, alive in _chunks(block):
            sweep = Lanes(sym, alive, initial, transition, emission)
            ll += np.log(sweep.scale, dtype=float).sum()
            gamma = np.empty_like(sweep.alpha)
            f, p = sweep.gammas(gamma)
            first, pairs = first + f, pairs + p
            held.append((sym, gamma))
            room += len(sym)
            if room >= COUNT_WORDS:
                settle()
        settle()
        back = np.empty_like(emitted)
        back[place] = emitted
        buckets, where = _by_bucket(h, bits)
        sums = np.concatenate((first, pairs.ravel(), [ll]))
        group = -1 - block["block"][0].as_py() % SUM_GROUPS
        return pa.table(
            {
                "bucket": pa.array([*buckets, group], pa.int32()),
                "h": pa.array([*(h[w].tobytes() for w in where), b""], pa.binary()),
                "c": pa.array([*(_packed(back[w]) for w in where), b""], pa.binary()),
                "sums": pa.array([None] * len(where) + [sums], pa.list_(pa.float64())),
            }
        )

    return run


def _sum_words(total: int, occupied: np.ndarray):
    """A bucket's words with their new counts; or, of a group of blocks (bucket < 0), the sums of all else."""
    states = len(occupied)

    def run(counted: pa.Table, words: pa.Table) -> pa.Table:
        if not words.num_rows:
            sums = np.sum([x.as_py() for x in counted["sums"]], axis=0)
            return pa.table({"bucket": counted["bucket"].slice(0, 1), "h": pa.array([b""], pa.binary()), "n": pa.array([b""], pa.binary()), "c": pa.array([b""], pa.binary()), "total": pa.array([sums], pa.list_(pa.float64()))})
        h, n = _binary(words, "h", np.uint64)[0], _binary(words, "n", np.int64)[0]
        c = PRIOR / total * n[:, None] + WORD_PRIOR * occupied / occupied.sum()
        for some, x in zip(_binary(counted, "h", np.uint64), counted["c"]):
            c[np.searchsorted(h, some)] += _unpacked(x.as_py(), states)  # the words of a block are distinct
        return _word_row(words["bucket"][0].as_py(), h, n, c)

    return run


def train(docs: DataFrame, coded: DataFrame, states: int = STATES, tolerance: float = TOLERANCE) -> Trained | None:
    """Baum-Welch over all words of the blocks of docs until a step gains less than `tolerance` bits a word. None without any word."""
    total, asked = coded.agg(F.sum("n_words"), F.sum("n_vocab")).first()
    if not total:
        return None
    bits = max(0, int(np.ceil(np.log2(asked / BUCKET_WORDS))))
    vocab, share, initial, transition = _sample_model(coded, total, states)
    counts = coded.select("vocab", "place", "symbols").mapInArrow(_frequency_batches(bits), "bucket int, h binary, n binary")
    words = cut(counts.groupBy("bucket").applyInArrow(_first_words(bits, vocab, share, states), WORDS), "zstd")
    model = Trained(words, bits, initial, transition, _totals(words, states), [])
    lean = coded.select("block", "vocab", "place", "symbols", "alive", "steps").groupBy("block")
    while True:
        found = emissions(coded, model, False).groupBy("block").cogroup(lean)
        found = found.applyInArrow(_count_block(model.initial, model.transition, model.occupied, bits), "bucket int, h binary, c binary, sums array<double>")
        known = model.words.select("bucket", "h", "n").filter("bucket >= 0").groupBy("bucket")
        words = cut(found.groupBy("bucket").cogroup(known).applyInArrow(_sum_words(total, model.occupied), WORDS), "zstd")
        drop(model.words)
        rows = words.filter("bucket < 0").select(F.posexplode("total").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
        sums = np.zeros(states + states**2 + 1)
        sums[[r.k for r in rows]] = [r.x for r in rows]
        first, pairs = sums[:states] + 1e-3, sums[states:-1].reshape(states, states) + 1e-3
        gains = [*model.gains, sums[-1] / np.log(2) / total]
        model = Trained(words.filter("bucket >= 0"), bits, first / first.sum(), pairs / pairs.sum(axis=1, keepdims=True), _totals(words, states), gains)
        model.words.cut_path = words.cut_path
        del found, known
        tidy(coded.sparkSession)  # the step's shuffle files
        if len(gains) > 1 and gains[-1] - gains[-2] < tolerance:
            return model


def _score_block(initial: np.ndarray, transition: np.ndarray, occupied: np.ndarray):
    def run(answers: pa.Table, block: pa.Table) -> pa.Table:
        words, sentences, order = (_binary(block, c, np.uint32)[0].astype(np.int64) for c in ("words", "sentences", "sentence"))
        emission = _emission(answers, block, occupied, True)
        ll = np.zeros(len(order))
        ll[order] = np.concatenate([np.zeros(0), *(Lanes(sym, alive, initial, transition, emission).log_likelihood() for sym, alive in _chunks(block))])
        total = np.bincount(np.repeat(np.arange(len(words)), sentences), ll, minlength=len(words)).astype(float)
        bits = pa.array(-total / np.log(2) / np.maximum(words, 1), mask=words == 0)
        ids = block["ids"].combine_chunks().flatten()
        return pa.table({"doc_id": ids, "n_words": words.astype(np.int32), "n_sentences": sentences.astype(np.int32), "log_likelihood": total, "bits_per_word": bits})

    return run


def score_blocks(coded: DataFrame, model: Trained | None, states: int = STATES) -> DataFrame:
    """The scores of all rows of the blocks; without a model there isn't a word either."""
    if model is None:
        zero = F.explode("ids").alias("doc_id"), F.lit(0).alias("n_words"), F.lit(0).alias("n_sentences"), F.lit(0.0).alias("log_likelihood"), F.lit(None).cast("double").alias("bits_per_word")
        return coded.select(*zero)
    rows = coded.select("block", "ids", "words", "sentences", "place", "symbols", "alive", "steps", "sentence")
    answers = emissions(coded, model, True).groupBy("block").cogroup(rows.groupBy("block"))
    return answers.applyInArrow(_score_block(model.initial, model.transition, model.occupied), SCORES)


def score(docs: DataFrame, states: int = STATES, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, n_words, n_sentences, log_likelihood (natural) and bits_per_word of every row."""
    coded = blocks(docs)
    return score_blocks(coded, train(docs, coded, states, tolerance))


def op6_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
