"""Suffix-array dedup (operator 1): all passages of `min_words` words or more that occur twice or more.

A window is a run of `min_words` words. It repeats if the same words occur at another place, in
any document. The result is, for each document, the union of its repeating windows.

1. A window's anchor is the least hash among its `gram`-word runs, the first of equal ones. The
   same words have the same anchor wherever they are, and the windows of one anchor are a run of
   neighbours, about 20 on the average. One row an anchor is enough to tell those that occur once.
2. Only the words around anchors that occur twice are sent, to a bucket by the anchor's hash. So
   any two equal windows meet in one bucket, and text that repeats nothing isn't moved there.
3. Each bucket sorts its suffixes, cut at `min_words`, by mergesort. Two suffixes are compared by
   prefix polynomial hashes: a binary search finds how many words they share, in a logarithmic
   number of steps. Merges work on all runs of a level at once. Windows that are neighbours in the
   suffix array and equal by hash are confirmed word by word.
4. Each class of equal windows has a first place, that of the least document and position.

Whole texts are read; nothing is capped. Words are compared as they stand; only the white space
between them is ignored.

Defined results
- Null, empty and short texts have no window. Rows with a null doc_id are left out.
- Repeated rows are copies like any others; their source is their own doc_id, and their spans are given once.
- Passages that touch or overlap in a document are one span.
- Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import common
from lodestar.llm.text import SPACE, Prefix, Words, mix

MIN_WORDS, GRAM = 50, 10
ANCHORS = pa.schema([("hash", pa.int64()), ("doc", pa.int64()), ("mark", pa.int32()), ("place", pa.int64())])
RUNS = pa.schema([("hash", pa.int64()), ("doc", pa.int64()), ("first", pa.int64()), ("ahead", pa.int32()), ("text", pa.large_binary())])
SPANS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("source", pa.int64()), ("later", pa.int64())])


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, where the least of values[i : i + width] is, the first of equals."""
    at = np.arange(len(values))
    done = 1
    while done < width:
        step = min(done, width - done)
        other = at[step:]
        head = at[: len(other)]
        at = np.where(values[other] < values[head], other, head)
        done += step
    return at


def anchors(words: Words, min_words: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, hash): the runs of windows of each anchor, in words of all texts."""
    n = len(words)
    if n < min_words:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    at = np.arange(n - gram + 1)
    grams = mix(Prefix(words.hash).of(at, at + gram))
    least = window_least(grams, min_words - gram + 1)
    text = words.text_of()
    window = np.flatnonzero(text[: len(least)] == text[min_words - 1 : min_words - 1 + len(least)])
    least, text = least[window], text[window]
    new = np.ones(len(window), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    return window[first], window[last], least[first], grams[least[first]].view(np.int64)


class Sorter:
    """Mergesort of suffixes (cut at depth) within groups, comparing by prefix hashes."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.symbols, self.depth, self.prefix = symbols, depth, Prefix(mix(symbols))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes at a and b share, depth at most, by binary search."""
        got = np.zeros(len(a), np.int64)
        step = 1 << (self.depth.bit_length() - 1)
        while step:
            ok = np.flatnonzero(got + step <= self.depth)
            x, y = a[ok] + got[ok], b[ok] + got[ok]
            got[ok[self.prefix.of(x, x + step) == self.prefix.of(y, y + step)]] += step
            step >>= 1
        return got

    def _before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix a is less than b, or equal to it where ties."""
        n = self.common(a, b)
        end = n >= self.depth
        k = np.where(end, 0, n)
        return np.where(end, ties, self.symbols[a + k] < self.symbols[b + k])

    def sort(self, suffixes: np.ndarray, group: np.ndarray) -> np.ndarray:
        """suffixes, which lie group by group, sorted within each."""
        out = suffixes.copy()
        new = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        size = np.diff(np.append(new, len(group)))
        start_of, size_of = np.repeat(new, size), np.repeat(size, size)
        width = 1
        while width < size.max(initial=0):
            at = np.flatnonzero(size_of > width)
            inside = at - start_of[at]
            base = inside // (2 * width) * (2 * width)
            right = inside - base >= width
            # The other run of the pair, which may be shorter or empty.
            lo = np.where(right, base, np.minimum(base + width, size_of[at]))
            hi = np.where(right, base + width, np.minimum(base + 2 * width, size_of[at]))
            lo, hi = lo + start_of[at], hi + start_of[at]
            from_ = lo.copy()
            mine = out[at]
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) >> 1
                less = self._before(out[mid], mine[open_], right[open_])  # equals: left ones first
                lo[open_] = np.where(less, mid + 1, lo[open_])
                hi[open_] = np.where(less, hi[open_], mid)
            place = start_of[at] + base + (inside - base - np.where(right, width, 0)) + (lo - from_)
            merged = out.copy()
            merged[place] = mine
            out = merged
            width *= 2
        return out


def _word_numbers(words: Words) -> np.ndarray:
    """The same number for the same word, by its bytes."""
    keep = words.data[~SPACE[words.data]]
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(words.end - words.start)))
    column = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(keep.tobytes())])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def _bucket(min_words: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("hash", "ascending"), ("doc", "ascending"), ("first", "ascending")]).combine_chunks()
        hash_, doc, first, ahead = (table.column(c).to_numpy() for c in ("hash", "doc", "first", "ahead"))
        words = Words(table.column("text").cast(pa.large_string()).combine_chunks())
        numbers = _word_numbers(words)
        windows = np.diff(words.off) - min_words + 1
        run_of = np.repeat(np.arange(len(windows)), windows)
        j = np.arange(len(run_of)) - np.repeat(np.cumsum(windows) - windows, windows)
        offset = ahead[run_of] - j  # of the anchor from the window: equal windows have equal ones
        by = np.lexsort((j, run_of, offset, hash_[run_of]))
        run_of, j = run_of[by], j[by]
        fresh = np.append(True, (hash_[run_of][1:] != hash_[run_of][:-1]) | (offset[by][1:] != offset[by][:-1]))
        group = np.cumsum(fresh)
        alone = np.append(fresh[1:], True) & fresh
        run_of, j, group = run_of[~alone], j[~alone], group[~alone]
        suffix = words.off[:-1][run_of] + j
        sorter = Sorter(numbers, min_words)
        order = sorter.sort(suffix, group)
        a, b = order[:-1], order[1:]
        same = (group[1:] == group[:-1]) & (sorter.common(a, b) >= min_words) if len(order) else np.zeros(0, bool)
        at = np.flatnonzero(same)
        for k in range(min_words):  # equal hashes are confirmed word by word
            same[at] &= numbers[a[at] + k] == numbers[b[at] + k]
        # Classes of equal windows in the order of the suffix array; merges kept (doc, position) order within.
        head = np.append(True, ~same)[: len(order)]
        size = np.diff(np.append(np.flatnonzero(head), len(order)))
        class_of = np.cumsum(head) - 1
        back = np.repeat(np.arange(len(windows)), np.diff(words.off))[order]
        twice = size[class_of] > 1
        doc_of, pos = doc[back], first[back] + order - words.off[:-1][back]
        source = doc_of[np.flatnonzero(head)][class_of]
        later, doc_of, pos, source = (~head)[twice], doc_of[twice], pos[twice], source[twice]
        by = np.lexsort((source, later, pos, doc_of))
        later, doc_of, pos, source = later[by], doc_of[by], pos[by], source[by]
        new = np.append(True, (doc_of[1:] != doc_of[:-1]) | (pos[1:] - pos[:-1] > 1))[: len(pos)]
        starts = np.flatnonzero(new)
        if not len(starts):
            return SPANS.empty_table()
        ends = np.append(starts[1:], len(pos)) - 1
        return pa.Table.from_arrays([pa.array(doc_of[starts]), pa.array(pos[starts]), pa.array(pos[ends] + min_words), pa.array(np.minimum.reduceat(source, starts)), pa.array(np.add.reduceat(later.astype(np.int64), starts))], schema=SPANS)

    return run


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, bucket_rows: int = 20_000) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, source_doc_id, later_windows): the spans of each document that
    repeat. Words count from 0, end_word is exclusive; source_doc_id is the least document that holds a window of the
    span; later_windows counts the windows that aren't the first of their kind (0: all are, so that the span may stay).
    """
    if not 1 <= gram <= min_words:
        raise ValueError("gram must be from 1 to min_words")
    source = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc is not null and text is not null").withColumn("mark", F.hash("text"))

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(1))
        first, last, anchor, hash_ = anchors(words, min_words, gram)
        text = words.text_of()[first]
        place = ((first - words.off[text]) << 16) | ((last - first) << 8) | (anchor - first)
        return common.rows([hash_, common.longs(batch.column(0))[text], batch.column(2).to_numpy()[text], place], ANCHORS)

    if min_words > 200:
        raise ValueError("min_words must be at most 200")
    found = common.map_arrow(source, find, ANCHORS).repartition("hash")
    twice = found.groupBy("hash").agg(F.count("*").alias("k")).where("k > 1").select("hash")
    # An anchor that a repeated row has once is counted twice, as its row occurs twice.
    places = common.cut(found.join(twice.hint("shuffle_hash"), "hash", "left_semi").select("doc", "mark", "place"))
    runs = places.count()
    buckets = max(1, -(-runs // bucket_rows))
    lists = places.groupBy("doc", "mark").agg(F.array_sort(F.collect_set("place")).alias("places"))
    wanted = source.join(lists.hint("shuffle_hash"), ["doc", "mark"]).select("doc", "text", "places")

    def cut_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(1))
        lists = batch.column(2)
        place = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        first = (place >> 16) + words.off[row]
        last, anchor = first + ((place >> 8) & 255), first + (place & 255)
        hash_ = mix(Prefix(words.hash).of(anchor, anchor + gram)).view(np.int64)
        start, end = words.start[first], words.end[last + min_words - 1]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(end - start)))
        at = np.repeat(start - ends[:-1], end - start) + np.arange(ends[-1])
        text = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(words.data[at].tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(hash_), pa.array(common.longs(batch.column(0))[row]), pa.array(place >> 16), pa.array((place & 255).astype(np.int32)), text], schema=RUNS)

    sent = common.map_arrow(wanted, cut_out, RUNS, most=2 << 20).withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    bucket = _bucket(min_words)
    spans = sent.groupBy("bucket").applyInArrow(lambda t: bucket(t), "doc_id long, start long, stop long, source long, later long")
    # Union of the spans of each document.
    w = Window.partitionBy("doc_id").orderBy("start", "stop")
    spans = spans.withColumn("before", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("island", F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(w))
    out = spans.groupBy("doc_id", "island").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("source").alias("source_doc_id"), F.sum("later").alias("later_windows"))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "source_doc_id", "later_windows")
