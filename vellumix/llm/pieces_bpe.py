"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut into units (a run of spaces and what follows up to the next space), which no piece crosses. The units' characters lie in one flat
numpy array of symbols. In each round the rank of every adjacent pair is known, a segmented minimum gives each unit's best
rank, all its pairs of that rank merge at once from the left, and the array is compacted, until no unit has a pair left.
A unit met again takes its pieces from a table that the worker keeps. Characters that are no piece become byte pieces.

The model is a file of the `sentencepiece` library (BPE, byte fallback, identity normalisation); its path is a parameter. Ids are
those of the library. Every batch is decoded again: `round_trip` says that the ids give back the text, byte for byte
(with U+2581, which the model can't tell from a space, as a space). Should that ever fail for a text, it is encoded anew without the table.

Defined results. A null text has null ids, an empty text none; both have 0 tokens. Whole texts of any length are encoded. Equal
ranks (ties) merge from the left. Repeated rows and null doc_ids are kept. Only doc_id and text are read by encode();
encode_columns() keeps all columns of its input, but for such with its new columns' names, which it replaces. Empty tables give empty results.
decode() takes any ids: control and unknown ids give nothing, invalid UTF-8 becomes U+FFFD, null ids a null text.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from .common import free_name, map_batches, pieces, table, worker_cache
from .words import mix

MODEL = os.environ.get("VELLUMIX_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
PIECE_BYTES, KEPT_UNITS = 1 << 21, 1 << 19
SPACE, NO_RANK = "▁", np.int32(2**31 - 1)


def spread(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i] + size[i]] for all i, one after another."""
    total = int(size.sum())
    shift = np.repeat(start - (np.cumsum(size) - size), size)
    return flat[shift + np.arange(total)]


class PairTable:
    """A hash table from pairs of symbols to the rank of their merger and the merged symbol."""

    def __init__(self, keys: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(8, int(len(keys) * 8).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank, self.merged = np.full(1 << self.bits, NO_RANK, np.int32), np.zeros(1 << self.bits, np.int32)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            slot = (self._slot(keys[left]) + self.probes) & ((1 << self.bits) - 1)
            free = np.flatnonzero(self.key[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.key[slot[put]], self.rank[slot[put]], self.merged[slot[put]] = keys[left[put]], rank[left[put]], merged[left[put]]
            left = np.delete(left, put)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        rank, merged = np.full(len(key), NO_RANK), np.zeros(len(key), np.int32)
        open_ = np.arange(len(key))
        for _ in range(self.probes):
            at = slot[open_]
            known = self.key[at]
            hit = known == key[open_]
            rank[open_[hit]], merged[open_[hit]] = self.rank[at[hit]], self.merged[at[hit]]
            more = ~hit & (known != -1)
            open_ = open_[more]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return rank, merged


class Vocabulary:
    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        piece, score = [sp.id_to_piece(i) for i in range(n)], np.array([sp.get_score(i) for i in range(n)])
        byte = np.array([sp.is_byte(i) for i in range(n)])
        special = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)])
        normal = [i for i in range(n) if not byte[i] and not special[i]]
        if byte.sum() != 256 or any(SPACE in piece[i].lstrip(SPACE) for i in normal) or sp.encode("a  ﬁ") != sp.encode(f"a{SPACE}{SPACE}ﬁ") or sp.decode(sp.encode("a  ﬁ ")) != "a  ﬁ ":
            raise ValueError("the model needs byte fallback, pieces with spaces at their beginning only, and identity normalisation")
        known = {piece[i]: i for i in normal}
        chars = sorted({c for p in known for c in p} - known.keys())
        known |= {c: n + k for k, c in enumerate(chars)}  # characters that are within pieces, but none themselves
        self.n = n
        order = np.lexsort((np.arange(n), -score))
        rank = np.empty(n, np.int32)
        rank[order] = np.arange(n)
        pairs = [(known[p[:k]], known[p[k:]], i) for p, i in ((piece[i], i) for i in normal) for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
        a, b, m = np.array(pairs, np.int64).T
        self.pairs = PairTable((a << 32) | b, rank[m], m.astype(np.int32))
        self.of_char = np.full(0x110000, -1, np.int32)
        for c, i in known.items():
            if len(c) == 1:
                self.of_char[32 if c == SPACE else ord(c)] = i
        self.of_char[ord(SPACE)] = self.of_char[32]
        self.of_byte = np.zeros(256, np.int32)
        for i in np.flatnonzero(byte):
            self.of_byte[int(piece[i][3:5], 16)] = i
        back = [b"" if special[i] else bytes([int(piece[i][3:5], 16)]) if byte[i] else piece[i].replace(SPACE, " ").encode() for i in range(n)]
        self.size = np.array([len(x) for x in back], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(back), np.uint8)
        self.code = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.power = self.inverse = np.ones(1, np.uint64)
        self.forget()

    def forget(self) -> None:
        self.hash, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.flat_start, self.flat_size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge_rounds(self, sym: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their units (in runs) when no pair is left."""
        rank, merged = np.full(len(sym), NO_RANK), np.zeros(len(sym), np.int32)  # of each symbol with the next one
        pair = np.flatnonzero(unit[1:] == unit[:-1])
        rank[pair], merged[pair] = self.pairs(sym[pair], sym[pair + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            size = np.diff(np.append(first, len(sym)))
            best = np.minimum.reduceat(rank, first)
            if (over := best == NO_RANK).any():
                out = np.repeat(over, size)
                done.append((sym[out], unit[out]))
                sym, unit, rank, merged = sym[~out], unit[~out], rank[~out], merged[~out]
                best, size = best[~over], size[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            run = np.concatenate(([True], np.diff(at) != 1))  # of pairs that overlap: each second one from the left merges
            begin = np.flatnonzero(run)
            nth = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
            at = at[nth % 2 == 0]
            sym[at] = merged[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new = (np.cumsum(keep) - 1)[at]
            rank[at], merged[at] = NO_RANK, 0
            sym, unit, rank, merged = sym[keep], unit[keep], rank[keep], merged[keep]
            rank[new] = NO_RANK  # the merged symbol's old right neighbour is gone
            touched = np.unique(np.concatenate((new, new[new > 0] - 1)))
            rank[touched] = NO_RANK
            touched = touched[touched + 1 < len(sym)]
            touched = touched[unit[touched] == unit[touched + 1]]
            rank[touched], merged[touched] = self.pairs(sym[touched], sym[touched + 1])
        if not done:
            return sym, unit
        sym, unit = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(unit, kind="stable")
        return sym[order], unit[order]

    def encode_units(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, and how many each has."""
        text = spread(raw, start, size)
        chars = np.frombuffer(text.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((text & 0xC0) != 0x80)
        unit = np.searchsorted(np.cumsum(size), lead, side="right")
        sym = self.of_char[chars]
        no = sym < 0
        sym[no] = -1 - chars[no].astype(np.int32)  # never part of a pair
        sym, unit = self.merge_rounds(sym, unit)
        raw_char = (sym < 0) | (sym >= self.n)
        if raw_char.any():  # byte pieces
            where = np.flatnonzero(raw_char)
            char_of = {i: c for c, i in ((c, int(self.of_char[c])) for c in np.flatnonzero(self.of_char >= self.n))}
            as_bytes = [chr(-1 - s if s < 0 else char_of[s]).encode() for s in sym[where].tolist()]
            count = np.ones(len(sym), np.int64)
            count[where] = [len(b) for b in as_bytes]
            unit = np.repeat(unit, count)
            out = np.repeat(sym, count)
            fill = np.repeat(raw_char, count)
            out[fill] = self.of_byte[np.frombuffer(b"".join(as_bytes), np.uint8)]
            sym = out
        return sym.astype(np.int32), np.bincount(unit, minlength=len(start)).astype(np.int64)

    def _grow(self, n: int) -> None:
        if n > len(self.power):
            p = 0x5851F42D4C957F2D
            for name, base in (("power", p), ("inverse", pow(p, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def encode(self, texts: list[bytes], kept: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, how many each has, the bytes encoded (a space before each text) and how many each has."""
        buf = b"".join(b" " + t for t in texts if t)
        raw = np.frombuffer(buf, np.uint8)
        length = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), raw, length
        first = (np.cumsum(length) - length)[length > 0]
        begin = raw == 32
        begin[1:] &= raw[:-1] != 32
        begin[first] = True
        start = np.flatnonzero(begin)
        size = np.diff(np.append(start, len(raw)))
        if kept:
            self._grow(len(raw) + 1)
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(self.code[raw] * self.power[: len(raw)], out=total[1:])
            h = mix((total[start + size] - total[start]) * self.inverse[start])
            seen, at, back = np.unique(h, return_index=True, return_inverse=True)
            if len(self.hash) > KEPT_UNITS:
                self.forget()
            place = np.searchsorted(self.hash, seen)
            new = np.ones(len(seen), bool)
            inside = place < len(self.hash)
            new[inside] = self.hash[place[inside]] != seen[inside]
            if new.any():
                ids, n = self.encode_units(raw, start[at[new]], size[at[new]])
                slot = len(self.flat_size) + np.arange(len(n))
                self.flat_start = np.concatenate((self.flat_start, len(self.flat) + np.cumsum(n) - n))
                self.flat_size, self.flat = np.concatenate((self.flat_size, n)), np.concatenate((self.flat, ids))
                self.hash, self.slot = np.insert(self.hash, place[new], seen[new]), np.insert(self.slot, place[new], slot)
                place = np.searchsorted(self.hash, seen)
            slot = self.slot[place][back]
            ids, n = spread(self.flat, self.flat_start[slot], self.flat_size[slot]), self.flat_size[slot]
        else:
            ids, n = self.encode_units(raw, start, size)
        per = np.zeros(len(texts), np.int64)
        per[length > 0] = np.add.reduceat(n, np.searchsorted(start, first))
        return ids, per, raw, length

    def decode(self, ids: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts, the space before each still there, and how many each has."""
        size = self.size[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        end = np.cumsum(per)
        return spread(self.bytes, self.start[ids], size), total[end] - total[end - per]


def vocabulary(model: bytes) -> Vocabulary:
    """The vocabulary, once per Python worker."""
    key = "pieces", hashlib.sha256(model).digest()
    cache = worker_cache()
    if key not in cache:
        cache[key] = Vocabulary(model)
    return cache[key]


def encode_array(texts: pa.Array, vocab: Vocabulary) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Ids of each text as a list array (null where the text is null), their number, and whether they decode to the text."""
    valid = np.asarray(texts.is_valid())
    rows = [b.replace(b"\xe2\x96\x81", b" ") for b in texts.cast(pa.binary()).fill_null(b"").to_pylist()]
    ids, per, raw, length = vocab.encode(rows)
    back, got = vocab.decode(ids, per)
    same = np.ones(len(rows), bool)
    if not (np.array_equal(back, raw) and np.array_equal(got, length)):
        at, frm = np.cumsum(length) - length, np.cumsum(got) - got
        same = np.array([np.array_equal(back[f : f + g], raw[a : a + n]) for f, g, a, n in zip(frm, got, at, length)])
        wrong = np.flatnonzero(~same)
        start = np.cumsum(per) - per
        parts = [ids[a : a + n] for a, n in zip(start, per)]
        for i in wrong:
            parts[i], n, one, size = vocab.encode([rows[i]], kept=False)
            per[i] = n[0]
            same[i] = np.array_equal(vocab.decode(parts[i], n)[0], one)
        ids = np.concatenate(parts)
    offsets = pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32), mask=np.append(~valid, False))
    return pa.ListArray.from_arrays(offsets, pa.array(ids)), per, pa.array(same, mask=~valid)


def _model(path: str) -> bytes:
    return Path(path).read_bytes()


def encode_columns(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs with piece_ids, n_pieces and round_trip. All three of an earlier encoding, told by their names and types, are replaced; beside other columns of such a name the new one's ends in an underscore."""
    types = dict(zip(("piece_ids", "n_pieces", "round_trip"), (ArrayType(IntegerType()), IntegerType(), BooleanType())))
    if all(any(f.name == c and f.dataType == t for f in docs.schema.fields) for c, t in types.items()):
        docs = docs.drop(*types)
    new = [free_name(docs, c) for c in types]
    docs = docs.withColumn("text", F.col("text").cast("string"))
    proto, at = _model(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(proto)
        for batch in batches:
            for part in pieces(batch, PIECE_BYTES):
                text = part.column(at)
                ids, n, same = encode_array(text if pa.types.is_string(text.type) else text.cast(pa.string()), vocab)
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(n.astype(np.int32)), same], [*part.schema.names, *new])

    return map_batches(docs, run, StructType([*docs.schema.fields, *(StructField(n, t) for n, t in zip(new, types.values()))]))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, piece_ids and round_trip of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return encode_columns(rows, model).select("doc_id", "n_pieces", "piece_ids", "round_trip")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and piece_ids."""
    proto = _model(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(proto)
        for batch in batches:
            col = batch.column(1)
            ids = np.asarray(col.flatten().fill_null(0), np.int64)
            ids = np.where((ids >= 0) & (ids < vocab.n), ids, 0)
            per = np.asarray(col.value_lengths().fill_null(0), np.int64)
            raw, size = vocab.decode(ids, per)
            end = np.cumsum(size)
            rows = [raw[e - s : e].tobytes().decode("utf-8", "replace") for s, e in zip(size, end)]
            rows = [r[1:] if r[:1] == " " else r for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string(), mask=~np.asarray(col.is_valid()))], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("piece_ids").cast("array<int>").alias("piece_ids")).mapInArrow(run, "doc_id long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
