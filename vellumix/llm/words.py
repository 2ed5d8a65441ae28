"""Words of many texts at once."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters whose lower case has another number of bytes keep their case, in texts and items alike, so offsets don't move.
MOVING = "".join(c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000)]) if len(c.lower().encode()) != len(c.encode()))


def lower(texts: pa.Array) -> pa.Array:
    """Lower case with as many bytes for each character as before."""
    low = pc.utf8_lower(texts)
    moving = pc.match_substring_regex(texts, f"[{MOVING}]")
    if pc.any(moving).as_py():
        out = low.to_pylist()
        for i in np.flatnonzero(moving.to_numpy(zero_copy_only=False)):
            part = re.split(f"([{re.escape(MOVING)}])", texts[i].as_py())
            part[::2] = pc.utf8_lower(pa.array(part[::2], pa.string())).to_pylist()
            out[i] = "".join(part)
        low = pa.array(out, pa.string())
    return low


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of all words (runs of ASCII letters, digits and bytes beyond ASCII) of many texts at once."""

    def __init__(self) -> None:
        self.is_word = np.zeros(256, bool)
        self.is_word[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
        self.code = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.power = self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.power):
            p = 0x5851F42D4C957F2D
            inv = pow(p, -1, 1 << 64)
            for name, base in (("power", p), ("inverse", inv)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def __call__(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text number and hash of every word, in order."""
        start, _, h = self.spans(raw, at)
        return np.searchsorted(at, start, side="right") - 1, h

    def spans(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of every word, in order."""
        n = len(raw)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.grow(n + 1)
        word = self.is_word[raw]
        first = np.zeros(n + 1, bool)
        first[at[:-1]] = True
        begin = word.copy()
        begin[1:] &= ~word[:-1] | first[1:n]
        end = word.copy()
        end[:-1] &= ~word[1:] | first[1:n]
        start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.code[raw] * self.power[:n], out=total[1:])
        return start, stop, mix((total[stop] - total[start]) * self.inverse[start])
