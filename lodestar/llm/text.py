"""Words of whole texts as arrays: positions and polynomial prefix hashes, without Python loops.

Hashes are polynomials modulo 2**64 with an odd base, so that the hash of any substring is
(P[e] - P[s]) / base**s, exact in wrapping arithmetic. Callers that must not err on a
collision compare the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

BLOCK = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
# Lower-case ASCII letters; ASCII signs become spaces; bytes of other characters stay.
FOLD = np.arange(256, dtype=np.uint8)
for _c in range(128):
    FOLD[_c] = ord(chr(_c).lower()) if chr(_c).isalnum() else 32


def mix(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Prefix:
    """Hashes of substrings of an array of symbols."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        power = np.full(n + 1, BASE, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])
        power[1:] = INVERSE
        self.back = np.cumprod(power, out=power)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each); a null text is empty."""
    a = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    offs = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


class Words:
    """Words (runs of bytes other than ASCII white space) of a column of texts.

    start, end: byte positions in `data`; hash: 64 bits a word; off: text i has the words
    off[i] to off[i + 1]. fold: letters in lower case and signs as spaces.
    """

    def __init__(self, column: pa.Array, fold: bool = False):
        data, self.at = text_bytes(column)
        self.data = data = FOLD[data] if fold else data
        n = len(data)
        space = SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        first, last = edge[:n].copy(), edge[1:].copy()
        first[1:] |= space[:-1]
        last[:-1] |= space[1:]
        self.start = np.flatnonzero(first & ~space)
        self.end = np.flatnonzero(last & ~space) + 1
        self.hash = np.empty(len(self.start), np.uint64)
        # Some bytes at a time: a prefix hash takes 8 bytes for each, and some more on the way.
        parts = np.append(np.searchsorted(self.start, np.arange(0, n, BLOCK)), len(self.start))
        for a, b in zip(parts[:-1], parts[1:], strict=True):
            if a < b:
                low, high = self.start[a], self.end[b - 1]
                self.hash[a:b] = Prefix(data[low:high]).of(self.start[a:b] - low, self.end[a:b] - low)
        self.hash = mix(self.hash + (self.end - self.start).astype(np.uint64))
        self.off = np.searchsorted(self.start, self.at)

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """The number of the text that each word is in."""
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    def slice(self, a: int, b: int) -> list[bytes]:
        return [self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True)]


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each run of n words. A text of fewer words has one, of all its words."""
    counts = np.diff(words.off)
    have = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    text = np.repeat(np.arange(len(counts)), have)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(have) - have, have)
    a = words.off[:-1][text] + inside
    b = np.minimum(a + n, words.off[1:][text])
    return text, mix(Prefix(words.hash).of(a, b))
