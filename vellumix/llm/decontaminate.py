"""Benchmark decontamination: one Aho-Corasick automaton over normalised test questions and answers.

Normal form: letters in lower case, every run of other characters (punctuation, white space, symbols) one space. The
automaton holds, of every item, windows of WINDOW words that begin every WINDOW_STEP words, so it has about as many nodes as
the items have characters, and any passage of WINDOW + WINDOW_STEP - 1 words holds a whole window. Texts are scanned once; each
hit is extended to both sides as far as text and item agree, and counts if it has at least MIN_WORDS words or is the whole item. Where more than
HOT items share a window, they are looked up by the MIN_WORDS words around it, so a hit costs the same however many begin alike. Offsets
are mapped back to characters of the original text.

Defined results. Null and empty texts have no hits, and null or empty items no windows. Items of fewer than WINDOW words
can't be told from ordinary prose and are left out. Texts of any length are scanned whole. Hits of one item in one text
that overlap or touch are one span; spans of several items (ties) are reported for each. Repeated rows and rows with a null doc_id are scanned
like others. Only doc_id and text, item_id and text are read; remove_contaminated() keeps all columns of docs, whatever their
names. Empty tables give empty results, and an empty benchmark leaves docs as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, pieces, table, text_of, worker_cache
from .words import lower

MIN_WORDS, WINDOW, WINDOW_STEP, HOT = 8, 5, 4, 8
PIECE_BYTES, GROUP_CHARS = 1 << 20, 20_000_000
KIND = np.zeros(256, np.uint8)  # 1: part of a word, 2: between texts
KIND[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = 1
KIND[0] = 2
HITS = "doc_id long, item_id long, start int, end int, n_words int"


class Normal:
    """Texts in normal form, one after another with NUL between them, and the way back."""

    def __init__(self, texts: pa.Array) -> None:
        rows = [b.replace(b"\0", b" ") for b in lower(texts).cast(pa.binary()).to_pylist()]
        buf = b" " + b" \0 ".join(rows) + b" "
        self.size = np.array([len(r) for r in rows], np.int64)
        self.start = 1 + np.concatenate(([0], np.cumsum(self.size + 3)[:-1])) if rows else np.zeros(0, np.int64)
        self.raw = raw = np.frombuffer(buf, np.uint8)
        kind = KIND[raw]
        for lead, follow in ((0xE2, (0x80, 0x81)), (0xC2, range(0xA0, 0xC0)), (0xE3, (0x80,))):  # general punctuation, Latin-1 signs, CJK punctuation
            at = np.flatnonzero(raw[:-1] == lead)
            at = at[np.isin(raw[at + 1], follow)]
            for k in range(2 if lead == 0xC2 else 3):
                kind[at + k] = 0
        keep = kind > 0
        keep[0] = True
        keep[1:] |= kind[:-1] > 0
        self.at = np.flatnonzero(keep)
        self.text = np.where(kind[self.at] > 0, raw[self.at], 32).astype(np.uint8).tobytes().decode("latin-1")

    def doc(self, at: int) -> int:
        """The number of the text that holds this place of the normal form."""
        return int(np.searchsorted(self.start, self.at[at], side="right")) - 1

    def chars(self, doc: int, at: int) -> int:
        """The place in the original text, in characters, of a byte of the buffer."""
        return int(np.count_nonzero((self.raw[self.start[doc] : at] & 0xC0) != 0x80))


def windows(items: list[tuple[int, str]], min_words: int = MIN_WORDS):
    """Items with their normal forms, and for each window's text the items (by position) and places that have it; for those of more than
    HOT items by the numbers of words before and behind, and these words with the window, that a hit has at least."""
    known, out = [], {}
    for (item_id, _), normal in zip(items, Normal(pa.array([text or "" for _, text in items], pa.string())).text.split("\0")):
        normal = f" {normal.strip()} "
        gap = [i for i, c in enumerate(normal) if c == " "]
        n = len(gap) - 1
        if n < WINDOW or item_id is None:
            continue
        known.append((item_id, normal))
        for w in {*range(0, n - WINDOW + 1, WINDOW_STEP), n - WINDOW}:
            out.setdefault(normal[gap[w] : gap[w + WINDOW] + 1], []).append((len(known) - 1, gap[w]))
    for window, where in out.items():
        if len(where) > HOT:
            out[window] = _by_words(known, where, window, min_words)
    return known, out


def _by_words(known: list[tuple[int, str]], where: list[tuple[int, int]], window: str, min_words: int) -> dict[tuple[int, int], dict[str, list[tuple[int, int]]]]:
    out: dict[tuple[int, int], dict[str, list[tuple[int, int]]]] = {}
    for item, place in where:
        text = known[item][1]
        end = place + len(window) - 1
        before, behind = text.count(" ", 0, place), text.count(" ", end + 1)
        more = max(0, min(min_words, before + WINDOW + behind) - WINDOW)
        begins, ends = [place], [end]
        for _ in range(min(more, before)):
            begins.append(text.rindex(" ", 0, begins[-1]))
        for _ in range(min(more, behind)):
            ends.append(text.index(" ", ends[-1] + 1))
        for left in range(max(0, more - behind), min(more, before) + 1):
            passage = text[begins[left] : ends[more - left] + 1]
            out.setdefault((left, more - left), {}).setdefault(passage, []).append((item, place))
    return out


def _around(s: str, begin: int, end: int, where) -> list[tuple[int, int]]:
    """The items of a hot window that agree with the text for as many words as a hit needs."""
    out = []
    for (left, right), found in where.items():
        i, e = begin, end
        for _ in range(left):
            i = s.rfind(" ", 0, i) if i > 0 else -1
        for _ in range(right):
            e = s.find(" ", e + 1) if e >= 0 else -1
        if i >= 0 and e >= 0:
            out += found.get(s[i : e + 1], ())
    return out


def automaton(items: list[tuple[int, str]], min_words: int = MIN_WORDS):
    """The items' normal forms and the automaton, once per Python worker."""
    import ahocorasick

    key = "aho", min_words, hashlib.sha256(repr(items).encode()).digest()
    cache = worker_cache()
    if key not in cache:
        known, found = windows(items, min_words)
        a = ahocorasick.Automaton()
        for text, where in found.items():
            a.add_word(text, (len(text), where))
        a.make_automaton()
        cache[key] = known, a
    return cache[key]


def _extended(s: str, known: list[tuple[int, str]], a, min_words: int, skip=None) -> Iterator[tuple[int, int, int]]:
    """Item (by position), begin and end of every hit; hits that begin at places of which skip() is true are left out."""
    reached: dict[tuple[int, int], int] = {}
    for end, (length, where) in a.iter(s):
        begin = end - length + 1
        if skip is not None and skip(begin):
            continue
        for item, place in where if isinstance(where, list) else _around(s, begin, end, where):
            if reached.get((item, begin - place), -1) > end:
                continue  # within what an earlier window of this alignment was extended to
            text = known[item][1]
            i, j = begin, place
            while j > 0 and s[i - 1] == text[j - 1]:
                i, j = i - 1, j - 1
            e, f = end, place + length - 1
            while f + 1 < len(text) and e + 1 < len(s) and s[e + 1] == text[f + 1]:
                e, f = e + 1, f + 1
            reached[item, begin - place] = e
            i, e = s.index(" ", i), s.rindex(" ", 0, e + 1)
            if s.count(" ", i, e) >= min(min_words, text.count(" ") - 1):
                yield item, i, e
                if skip is not None and skip(begin, True):
                    break


def scan(texts: pa.Array, known: list[tuple[int, str]], a, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int, int]]:
    """Position of the text, item_id, start, end and number of words of every hit."""
    if not known or not len(texts):
        return []
    normal = Normal(texts)
    s = normal.text
    spans: dict[tuple[int, int], int] = {}
    for item, i, e in _extended(s, known, a, min_words):
        spans[item, i] = max(spans.get((item, i), 0), e)
    out = []
    merged: list[list[int]] = []
    for (item, i), e in sorted(spans.items()):
        if merged and merged[-1][0] == item and i <= merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([item, i, e])
    for item, i, e in merged:
        doc = normal.doc(i + 1)
        first, last = int(normal.at[i + 1]), int(normal.at[e - 1]) + 1
        out.append((doc, known[item][0], normal.chars(doc, first), normal.chars(doc, last), s.count(" ", i, e)))
    return sorted(out)


def contaminated(texts: pa.Array, known: list[tuple[int, str]], a, min_words: int = MIN_WORDS) -> np.ndarray:
    """Whether each text has a hit; a text is left at its first."""
    out = np.zeros(len(texts), bool)
    if known and len(texts):
        normal = Normal(texts)

        def skip(begin: int, found: bool = False) -> bool:
            doc = normal.doc(begin + 1)
            out[doc] |= found
            return bool(out[doc])

        for _ in _extended(normal.text, known, a, min_words, skip):
            pass
    return out


def _groups(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The items, in as many automata as memory asks for: one up to GROUP_CHARS characters."""
    out, size = [[]], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator():
        if size + len(r[1]) > GROUP_CHARS and out[-1]:
            out.append([])
            size = 0
        out[-1].append((r[0], r[1]))
        size += len(r[1])
    return out


def _hit_batches(items: list[tuple[int, str]], min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, a = automaton(items, min_words)
        for batch in batches:
            for part in pieces(batch, PIECE_BYTES):
                hits = scan(text_of(part), known, a, min_words)
                col = [[h[k] for h in hits] for k in range(5)]
                ids = part.column(0).take(pa.array(col[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(col[1], pa.int64()), *(pa.array(c, pa.int32()) for c in col[2:])], ["doc_id", "item_id", "start", "end", "n_words"])

    return run


def hits(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, item_id, start, end (characters of the text) and n_words of every passage of a test item."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in _groups(benchmark):
        found = rows.mapInArrow(_hit_batches(items, min_words), HITS)
        out = found if out is None else out.union(found)
    return out


def _clean_batches(items: list[tuple[int, str]], at: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, a = automaton(items, min_words)
        for batch in batches:
            text = batch.column(at)
            text = (text if pa.types.is_string(text.type) else text.cast(pa.string())).fill_null("")
            start, clean = 0, np.ones(batch.num_rows, bool)
            for part in pieces(pa.RecordBatch.from_arrays([text], ["text"]), PIECE_BYTES):
                clean[start : start + part.num_rows] = ~contaminated(part.column(0), known, a, min_words)
                start += part.num_rows
            yield batch.filter(pa.array(clean))

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs without a passage of a test item."""
    at = docs.columns.index("text")
    for items in _groups(benchmark):
        docs = map_batches(docs, _clean_batches(items, at, min_words), docs.schema)
    return docs


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
