"""Near-duplicate documents by SimHash: all pairs within the budget are found, in large sets with binary tries.

A document's fingerprint has 256 bits: each distinct lower-cased word votes on every bit. Two documents are near copies
if their fingerprints differ in at most `budget` bits and their word counts in at most a fifth. Groups are the connected
components of that relation; the smallest doc_id of a group stands for it.

Search, exact in two steps. (1) Word counts fall into bands, each somewhat wider than the ratio allowed, so near copies lie in one band
or in two neighbouring ones. Bands of more than CELL leaves are split into cells by a hash; each pair of cells of one band or of neighbouring bands, and each
cell with itself, is a task. (2) A small task compares all pairs whose word counts allow it. In a large one the bits are read as a ring of boxes; the boxes are allowed ALLOWED differing bits each, budget + 1 in all.
A pair that differs in budget bits at most stays below what is allowed in all; so there is a box from which on, around the ring,
it stays below what the boxes so far are allowed, after each of them (the cycle lemma). The leaves are put into one trie for each box to begin with, pairs of nodes are traversed
together, level by level, adding up the bits in which they differ, and a pair is pruned once it has what its boxes are allowed. No pair is
missed, whatever bits it differs in, and pairs met are compared over all bits: no false ones.

The work grows with the leaves of a task to the power 1 to 2; beyond CELL leaves in a band it grows with their square, as the number of tasks does.

Defined results. Null or empty texts and texts without a word are never grouped. Rows with a null doc_id are left out of
near_duplicates() and kept by deduplicate(). Rows that repeat a doc_id count as one document, near to all that any of its
texts is near to; deduplicate() keeps one of them. Equal fingerprints (ties) go to the smallest doc_id. Only doc_id and
text are read, so other columns may have any name. An empty table gives an empty result. Texts of any length are read
whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, free_name, pieces, table, text_of, utf8
from .words import WordHasher, mix

BITS, BUDGET, LENGTH_RATIO, ALLOWED = 256, 40, 0.8, 2
BAND_RATIO = 1 / LENGTH_RATIO + 0.01  # somewhat more than the ratio, so that rounding can't put near copies two bands apart
PIECE_BYTES, CELL, LEAF_PAIRS, SLICE, MOST_TASKS = 1 << 18, 1 << 19, 256, 1 << 18, 4096
DENSE_PAIRS, DENSE_ROWS, DENSE_COLUMNS = 1 << 30, 32, 2048  # up to so many pairs of leaves, all pairs take less time than tries
SEEDS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)

#: For each byte its bits, the lowest first, as 8 bytes.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint_arrays(texts: pa.Array, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Number of words, and the fingerprint as four 64-bit words, of each text."""
    raw, at = utf8(pc.utf8_lower(texts))
    doc, h = hasher(raw, at)
    count = np.bincount(doc, minlength=len(texts))
    out = np.zeros((len(texts), 4), np.uint64)
    if len(doc):
        key = (doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
        key.sort()
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        owner = (key >> np.uint64(48)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        size = np.diff(np.append(begin, len(key)))
        low = key & np.uint64((1 << 48) - 1)
        votes = np.stack([mix(low * s + s) for s in SEEDS], axis=1).view(np.uint8)
        runs = (size + 254) // 255  # of at most 255 words, whose votes are added in bytes, 8 bits at once
        last = np.cumsum(runs)
        start = np.repeat(begin, runs) + 255 * (np.arange(last[-1]) - np.repeat(last - runs, runs))
        part = np.add.reduceat(LANES[votes], start, axis=0).view(np.uint8)
        total = np.add.reduceat(part.astype(np.int32), last - runs, axis=0)
        set_bits = np.packbits(2 * total > size[:, None], axis=1, bitorder="little")
        out[owner[begin]] = np.ascontiguousarray(set_bits).view(np.uint64)
    return count, out


FINGERPRINT = "doc_id long, n_words int, f0 long, f1 long, f2 long, f3 long"


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        for part in pieces(batch, PIECE_BYTES):
            n, f = fingerprint_arrays(text_of(part), hasher)
            cols = [part.column(0), pa.array(n.astype(np.int32)), *(pa.array(f[:, k].view(np.int64)) for k in range(4))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "f0", "f1", "f2", "f3"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and the fingerprint of every row with a doc_id and at least one word."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_fingerprint_batches, FINGERPRINT).filter("n_words > 0")


def rings(budget: int) -> list[tuple[int, np.ndarray]]:
    """The bit at which each trie begins, and the most differing bits that a pair may have after each number of its bits."""
    boxes = max(1, (budget + 1) // ALLOWED)
    allowed = np.full(boxes, ALLOWED)
    allowed[-1] += budget + 1 - allowed.sum()
    edge = np.concatenate(([0], np.round(np.cumsum(allowed) * BITS / (budget + 1)).astype(np.int64)))  # wider where more is allowed
    out = []
    for k in range(boxes):
        bits, most = np.roll(np.diff(edge), -k), np.cumsum(np.roll(allowed, -k)) - 1
        out.append((int(edge[k]), np.concatenate(([0], np.repeat(most, bits)))))
    return out


def rotated(f: np.ndarray, start: int) -> np.ndarray:
    """Fingerprints (bit i: bit 63 - i % 64 of word i // 64) that begin with bit `start` and go around."""
    word, bit = divmod(start, 64)
    f = np.roll(f, -word, axis=1)
    return f if bit == 0 else (f << np.uint64(bit)) | (np.roll(f, -1, axis=1) >> np.uint64(64 - bit))


def connect(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of all pairs a, b; a component's label is the smallest position in it."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def dense_join(group: np.ndarray, f: np.ndarray, n_words: np.ndarray, across: bool, budget: int = BUDGET) -> np.ndarray:
    """The same labels as trie_self_join(), from all pairs whose numbers of words allow it."""
    label = np.arange(len(group))
    u = np.argsort(n_words, kind="stable")
    u, v = (u[group[u] == group.min()], u[group[u] != group.min()]) if across else (u, u)
    u_words, v_words, v_bits = n_words[u], n_words[v], [np.ascontiguousarray(f[v, part]) for part in range(4)]
    for i in range(0, len(u), DENSE_ROWS):
        row = u[i : i + DENSE_ROWS]
        begin = np.searchsorted(v_words, int(LENGTH_RATIO * u_words[i]))
        end = np.searchsorted(v_words, u_words[i : i + DENSE_ROWS][-1] / LENGTH_RATIO + 1, side="right")
        for j in range(begin, end, DENSE_COLUMNS):
            at = slice(j, min(end, j + DENSE_COLUMNS))
            err = np.bitwise_count(f[row, 0][:, None] ^ v_bits[0][at])
            err += np.bitwise_count(f[row, 1][:, None] ^ v_bits[1][at])
            a, b = np.divmod(np.flatnonzero(err <= budget), at.stop - j)
            a, b = row[a], v[b + j]
            lo, hi = np.minimum(n_words[a], n_words[b]), np.maximum(n_words[a], n_words[b])
            ok = (lo >= LENGTH_RATIO * hi) & (a != b)
            ok[ok] = np.bitwise_count(f[a[ok]] ^ f[b[ok]]).sum(axis=1, dtype=np.int32) <= budget
            connect(label, a[ok], b[ok])
    return label


def trie_self_join(group: np.ndarray, f: np.ndarray, n_words: np.ndarray, across: bool, budget: int = BUDGET, most: np.ndarray | None = None) -> np.ndarray:
    """Component label (smallest position) of every leaf. group: each leaf's set; pairs within sets count or, across, those of the first set with the second.
    most: the differing bits that a pair may have after each number of bits, if fewer than the budget."""
    n = len(group)
    most = np.full(BITS + 1, budget) if most is None else np.minimum(most, budget)
    order = np.lexsort((f[:, 3], f[:, 2], f[:, 1], f[:, 0], group))
    g, f, words = group[order], f[order], n_words[order]
    words_of = [np.ascontiguousarray(f[:, part]) for part in range(4)]
    label = np.arange(n)
    zeros: dict[int, np.ndarray] = {}

    def zeros_before(level: int) -> np.ndarray:
        if level not in zeros:
            if len(zeros) > 24:
                zeros.clear()
            bit = (f[:, level // 64] >> np.uint64(63 - level % 64)) & np.uint64(1)
            zeros[level] = np.concatenate((np.zeros(1, np.int32), np.cumsum(bit == 0, dtype=np.int32)))
        return zeros[level]

    def compare(ulo, uhi, vlo, vhi) -> None:
        """All pairs of leaves below pairs of nodes: a row for each leaf of the first, a run of leaves of the second."""
        rows = uhi - ulo
        left = np.arange(rows.sum()) + np.repeat(ulo - np.cumsum(rows) + rows, rows)
        width, first = np.repeat(vhi - vlo, rows), np.repeat(vlo, rows)
        total = np.cumsum(width)
        start = 0
        while start < len(left):
            base = total[start] - width[start]
            end = max(start + 1, int(np.searchsorted(total, base + SLICE, side="right")))
            w, upto = width[start:end], total[start:end] - base
            b = np.arange(upto[-1]) + np.repeat(first[start:end] - upto + w, w)
            err = np.bitwise_count(np.repeat(words_of[0][left[start:end]], w) ^ words_of[0][b])
            ok = np.flatnonzero(err <= most[64])
            a, b, err = left[start + np.searchsorted(upto, ok, side="right")], b[ok], err[ok].astype(np.int32)
            for part in range(1, 4):  # pruned after every 64 levels
                err = err + np.bitwise_count(words_of[part][a] ^ words_of[part][b])
                ok = np.flatnonzero((err <= most[64 * part + 64]) & (a < b))
                a, b, err = a[ok], b[ok], err[ok]
            lo, hi = np.minimum(words[a], words[b]), np.maximum(words[a], words[b])
            ok = lo >= LENGTH_RATIO * hi
            connect(label, a[ok], b[ok])
            start = end

    begin = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if n else np.zeros(0, np.int64)
    stop = np.append(begin[1:], n)
    u, v = (slice(0, 1), slice(1, 2)) if across else (slice(None), slice(None))
    stack = [(0, begin[u], stop[u], begin[v], stop[v], np.zeros(len(begin[u]), np.int32))] if not across or len(begin) == 2 else []
    while stack:
        level, ulo, uhi, vlo, vhi, err = stack.pop()
        small = ((uhi - ulo) * (vhi - vlo) <= LEAF_PAIRS) | (level >= BITS)
        compare(ulo[small], uhi[small], vlo[small], vhi[small])
        ulo, uhi, vlo, vhi, err = (x[~small] for x in (ulo, uhi, vlo, vhi, err))
        if not len(ulo):
            continue
        z = zeros_before(level)
        umid, vmid = ulo + z[uhi] - z[ulo], vlo + z[vhi] - z[vlo]
        other = ulo != vlo  # a node paired with itself has one mixed pair of children, not two
        children = [(ulo, umid, vlo, vmid, err), (umid, uhi, vmid, vhi, err), (ulo, umid, vmid, vhi, err + 1), (umid[other], uhi[other], vlo[other], vmid[other], err[other] + 1)]
        nxt = [np.concatenate(x) for x in zip(*children)]
        alive = (nxt[4] <= most[level + 1]) & (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & ~((nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1))
        nxt = [x[alive] for x in nxt]
        for i in range(0, len(nxt[0]), SLICE // 4):
            stack.append((level + 1, *(x[i : i + SLICE // 4] for x in nxt)))
    # smallest original position of each component
    back = np.empty(n, np.int64)
    low = np.full(n, n, np.int64)
    np.minimum.at(low, label, order)
    back[order] = low[label]
    return back


def near_pairs(side: np.ndarray, f: np.ndarray, n_words: np.ndarray, across: bool, budget: int = BUDGET) -> np.ndarray:
    """Pairs of positions that connect all near leaves of one cell or, across, all near pairs of leaves of two cells (sides 0 and 1)."""
    first = np.count_nonzero(side == side[0])
    if first * (len(side) - first if across else first) <= DENSE_PAIRS:
        found = [dense_join(side, f, n_words, across, budget)]
    else:
        found = (trie_self_join(side, rotated(f, start), n_words, across, budget, most) for start, most in rings(budget))
    edges = []
    for top in found:
        a = np.flatnonzero(top != np.arange(len(top)))
        edges.append(a * len(top) + top[a])
    return np.stack(np.divmod(np.unique(np.concatenate(edges)), max(1, len(side))), axis=1)


def _join_batches(budget: int):
    def task_edges(rows: pa.Table) -> pa.RecordBatch:
        num = {c: rows.column(c).to_numpy() for c in rows.column_names}
        f = np.stack([num[f"f{k}"].view(np.uint64) for k in range(4)], axis=1)
        across = bool(num["low"][0] != num["high"][0])
        pairs = near_pairs(num["side"], f, num["n_words"], across, budget)
        return pa.RecordBatch.from_arrays([pa.array(num["leaf"][pairs[:, k]]) for k in range(2)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, task = [], None
        for batch in batches:
            low, high = (batch.column(c).to_numpy() for c in ("low", "high"))
            edges = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]))))[: batch.num_rows]
            for lo, hi in zip(edges, np.append(edges[1:], batch.num_rows)):
                if held and task != (low[lo], high[lo]):
                    yield task_edges(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
                task = low[lo], high[lo]
        if held:
            yield task_edges(pa.Table.from_batches(held))

    return run


def band_of(n_words: np.ndarray) -> np.ndarray:
    """Bands of word counts: counts within the ratio lie in one band or in neighbouring ones."""
    return np.floor(np.log(n_words.astype(np.float64)) / math.log(BAND_RATIO)).astype(np.int64)


def near_edges(leaves: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Edges a, b that connect all near leaves."""

    def band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(band_of(batch.column(0).to_numpy()))], ["band"])

    sizes = leaves.select("n_words").mapInArrow(band_batches, "band long").groupBy("band").count().collect()  # a row for each band: some 60
    cells = {r["band"]: math.ceil(r["count"] / CELL) for r in sizes}
    first = dict(zip(sorted(cells), np.cumsum([0, *(cells[b] for b in sorted(cells))]).tolist()))

    def spread_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band = band_of(batch.column("n_words").to_numpy())
            hashed = mix(batch.column("leaf").to_numpy().view(np.uint64) + SEEDS[0])
            for b in np.unique(band).tolist():
                at = np.flatnonzero(band == b)
                part = batch.take(pa.array(at))
                own = first[b] + (hashed[at] % np.uint64(cells[b])).astype(np.int64)
                for other in (first[x] + k for x in (b - 1, b, b + 1) if x in cells for k in range(cells[x])):
                    low, high = np.minimum(own, other), np.maximum(own, other)
                    key = [pa.array(low), pa.array(high), pa.array((own > other).astype(np.int8))]
                    yield pa.RecordBatch.from_arrays([*key, *part.columns], ["low", "high", "side", *part.schema.names])

    wanted = leaves.select("leaf", "n_words", "f0", "f1", "f2", "f3")
    rows = wanted.mapInArrow(spread_batches, "low long, high long, side byte, leaf long, n_words int, f0 long, f1 long, f2 long, f3 long")
    tasks = sum(n * (n + 1) // 2 + n * cells.get(b + 1, 0) for b, n in cells.items())
    # few bytes and much work: a fixed number of partitions, so that they aren't joined by size
    rows = rows.repartition(max(1, min(MOST_TASKS, 2 * tasks)), "low", "high").sortWithinPartitions("low", "high")
    return rows.mapInArrow(_join_batches(budget), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) of every node but the roots, by alternating large and small stars."""
    at = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    at, seen = cut(at), None
    while True:
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))  # combined before the shuffle, so a node of very many edges is no hot group
        large = both.join(low, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        nxt = cut(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct())
        drop(at)
        at, before = nxt, seen
        seen = at.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == before or seen[0] == 0:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id and duplicate_of, the smallest doc_id of its group, for every document but those that stand for a group."""
    print_ = ["n_words", "f0", "f1", "f2", "f3"]
    known = cut(fingerprints(docs))
    leaves = cut(known.groupBy(*print_).agg(F.min("doc_id").alias("leaf")))
    same = cut(known.join(leaves, print_).select("doc_id", "leaf"))
    drop(known)
    own = same.groupBy("doc_id").agg(F.min("leaf").alias("low"), F.max("leaf").alias("high"))
    # a doc_id with several texts is one document, so it links the groups of all of them
    links = same.join(own.filter("low < high"), "doc_id").filter("leaf <> low").select(F.col("leaf").alias("a"), F.col("low").alias("b"))
    roots = components(near_edges(leaves, budget).union(links))
    drop(leaves)
    found = own.join(roots, own.low == roots.node, "left").select("doc_id", F.coalesce("root", "low").alias("duplicate_of"))
    return found.filter("doc_id <> duplicate_of")


def deduplicate(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """docs without its near duplicates; all columns stay. Of rows with one doc_id the longest text stays, between texts of one length the one with the
    smallest hash, and between rows of equal text the one with the smallest hash of all its columns but maps; rows without a doc_id all stay."""
    other = free_name(docs, "__gone")
    ident = F.col("doc_id").cast("long")
    gone = near_duplicates(docs, budget).select(F.col("doc_id").alias(other))
    left = docs.filter(ident.isNotNull()).join(gone, ident == F.col(other), "left_anti")
    every = [F.col("`" + f.name.replace("`", "``") + "`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    first = Window.partitionBy(ident).orderBy(F.length("text").desc(), F.xxhash64("text"), F.xxhash64(*every))
    left = left.withColumn(other, F.row_number().over(first)).filter(F.col(other) == 1).drop(other)
    return left.union(docs.filter(ident.isNull()))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
