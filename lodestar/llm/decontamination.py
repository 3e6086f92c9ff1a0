"""Benchmark decontamination (operator 5): suffix arrays of the training texts.

Every piece of the documents (some megabytes of whole texts) gets a suffix array over its
words. Each suffix of each benchmark item is binary-searched in each array, which yields its
longest verbatim match and all places with one of at least `min_words` words. Words are
compared as they stand; only the white space between them is ignored. Matches are found by
hashes and confirmed by comparing the words.

The pass over the documents is narrow: nothing is shuffled but the matches.

Defined results
- Null or empty texts and items hold no words and match nothing. Rows with a null doc_id
  can't be named in `matches`, but `decontaminate` judges them by their text like others.
- An item of fewer than `min_words` words matches where it occurs as a whole.
- Ties between places go to the first in the document, then the first in the item.
- Repeated rows of a document give one match for an item; repeated items (one item_id) count as one item.
- Other columns, whatever their names, are ignored by `matches` and kept by `decontaminate`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import common
from lodestar.llm.text import Prefix, Words, mix

MIN_WORDS = 13
SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("match_words", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64())])


class SuffixArray:
    """Suffixes of an array of symbol numbers, sorted by their first `depth` symbols."""

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        self.symbols, self.prefix = symbols, Prefix(mix(symbols))
        bits = max(1, int(symbols.max(initial=0)).bit_length())
        width = max(1, 62 // bits)
        key = np.zeros(n, np.int64)
        for k in range(width):  # the first `width` symbols in one integer
            key <<= bits
            key[: n - k] |= symbols[k:]
        order = np.argsort(key)
        fresh = np.empty(n, bool)
        fresh[:1] = True
        sorted_key = key[order]
        fresh[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.zeros(n + 1, np.int64)
        rank[n] = -1
        reached = width
        while reached < depth:  # prefix doubling, of those alone that are tied
            head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            rank[order] = head
            tied = ~fresh
            tied[:-1] |= ~fresh[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            who = order[at]
            second = rank[np.minimum(who + reached, n)] + 1
            by = np.lexsort((second, head[at]))
            order[at] = who[by]
            first, second = head[at], second[by]
            fresh[at[1:]] |= (second[1:] != second[:-1]) | (first[1:] != first[:-1])
            reached *= 2
        self.order = order

    def common(self, other: SuffixArray | Pattern, i: np.ndarray, limit: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that other's suffix i (up to limit) and this array's suffix j share."""
        room = np.minimum(limit - i, len(self.symbols) - j)
        got = np.zeros(len(i), np.int64)
        step = 1 << max(0, int(room.max(initial=0)).bit_length() - 1)
        while step:
            ok = np.flatnonzero(got + step <= room)
            a, b = i[ok] + got[ok], j[ok] + got[ok]
            same = other.prefix.of(a, a + step) == self.prefix.of(b, b + step)
            got[ok[same]] += step
            step >>= 1
        return got

    def bound(self, other: Pattern, i: np.ndarray, limit: np.ndarray, after: bool) -> np.ndarray:
        """Where other's suffix i, cut at limit, goes: before or after the suffixes that start with it."""
        lo, hi = np.zeros(len(i), np.int64), np.full(len(i), len(self.order), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            a, end, j = i[open_], limit[open_], self.order[mid]
            l = self.common(other, a, end, j)
            whole = a + l >= end
            mine = np.where(j + l < len(self.symbols), self.symbols[np.minimum(j + l, len(self.symbols) - 1)], -1)
            less = np.where(whole, after, mine < other.symbols[np.minimum(a + l, len(other.symbols) - 1)])
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        return lo


class Pattern:
    def __init__(self, symbols: np.ndarray):
        self.symbols, self.prefix = symbols, Prefix(mix(symbols))


class Benchmark:
    """Words of the benchmark's items."""

    def __init__(self, ids: list[int], texts: list[str], min_words: int):
        words = Words(pa.array(texts, pa.string()))
        self.ids, self.off, self.hash = np.array(ids, np.int64), words.off, words.hash
        self.words = words.slice(0, len(words))
        length = np.diff(words.off)
        self.item = words.text_of()
        self.need = np.minimum(min_words, length)[self.item]
        self.end = words.off[1:][self.item]
        self.depth = int(length.max(initial=0))
        self.suffix = np.flatnonzero(np.arange(len(self.item)) + self.need <= self.end)

    def search(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(text number, item number, words, first word in the text, in the item) of the longest match of each text and item."""
        none = tuple(np.zeros(0, np.int64) for _ in range(5))
        words = Words(texts)
        if not len(words) or not len(self.suffix):
            return none
        vocabulary, ids = np.unique(words.hash, return_inverse=True)
        # Number 0 parts the texts: symbol k of text t is at k + t.
        text = words.text_of()
        symbols = np.zeros(len(words) + len(words.off) - 1, np.int64)
        place = np.arange(len(words)) + text
        symbols[place] = ids + 1
        known = np.minimum(np.searchsorted(vocabulary, self.hash), len(vocabulary) - 1)
        pattern = Pattern(np.where(vocabulary[known] == self.hash, known + 1, len(vocabulary) + 1))
        tree = SuffixArray(symbols, self.depth)
        i = self.suffix
        short = i + self.need[i]
        lo = tree.bound(pattern, i, short, False)
        hi = tree.bound(pattern, i, short, True)
        count = hi - lo
        if not count.sum():
            return none
        i = np.repeat(i, count)
        j = tree.order[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        length = tree.common(pattern, i, self.end[i], j)
        back = np.cumsum(symbols == 0) - (symbols == 0)  # text numbers of symbols
        t = back[j]
        first, item = j - t - words.off[t], i - self.off[self.item[i]]
        by = np.lexsort((item, first, -length, self.item[i], t))
        t, which, length, first, item = t[by], self.item[i][by], length[by], first[by], item[by]
        best = np.ones(len(t), bool)
        best[1:] = (t[1:] != t[:-1]) | (which[1:] != which[:-1])
        t, which, length, first, item = (x[best] for x in (t, which, length, first, item))
        real = np.array([words.slice(words.off[a] + f, words.off[a] + f + n) == self.words[self.off[b] + g : self.off[b] + g + n] for a, b, n, f, g in zip(t, which, length, first, item, strict=True)], bool)
        return tuple(x[real] for x in (t, which, length, first, item))


def _benchmarks(benchmark: DataFrame, min_words: int, limit_bytes: int) -> list[Benchmark]:
    """The items in as many parts as it takes to keep each below limit_bytes; one part goes to the tasks at a time."""
    if min_words < 1:
        raise ValueError("min_words must be at least 1")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // limit_bytes))
    out = []
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else items
        got = sorted((tuple(r) for r in part.groupBy("item_id").agg(F.min("text").alias("text")).collect()))
        out.append(Benchmark([r[0] for r in got], [r[1] for r in got], min_words))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, limit_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, item_id, match_words, doc_word, item_word): for each document and item the longest run of
    words that they share, if it has min_words (or is the whole item), and where it begins, in words from 0.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    out = None
    for part in _benchmarks(benchmark, min_words, limit_bytes):

        def kernel(batch: pa.RecordBatch, part: Benchmark = part) -> pa.RecordBatch:
            t, which, *rest = part.search(batch.column(1))
            return common.rows([common.longs(batch.column(0))[t], part.ids[which], *rest], SCHEMA)

        found = common.map_arrow(source, kernel, SCHEMA)
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("match_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best.match_words").alias("match_words"), (-F.col("best.d")).alias("doc_word"), (-F.col("best.i")).alias("item_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, limit_bytes: int = 32 << 20) -> DataFrame:
    """docs, with all columns, without the rows whose text matches an item as in `matches`."""
    at = docs.columns.index("text")
    for part in _benchmarks(benchmark, min_words, limit_bytes):

        def run(batches, part: Benchmark = part):
            for batch in common.pieces(batches, at):
                keep = np.ones(batch.num_rows, bool)
                keep[part.search(batch.column(at))[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
