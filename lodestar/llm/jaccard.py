"""N-gram Jaccard join (operator 8): a token-group matrix over whole token sets, exact.

A document is the set of its runs of `n` folded words (letters in lower case, signs as
spaces). The join finds the pairs of sets with a Jaccard similarity of at least `threshold`.

1. Documents with the same set are one class, named by its least doc_id.
2. Sets are parted into groups of similar ones: by the least hash among the tokens that are as
   frequent as the set's middle one, which neither a passage that many documents share nor the
   words that an edit brought in can decide, and by the power of two of their size.
3. The token-group matrix holds the union of each group's tokens. Tokens have one order, rarest
   first; sets whose similarity reaches the threshold share `least` tokens among the first of
   them (see `_packets`). So the matrix needs these alone, and what bounds the overlap of two groups
   is the number of such tokens that both unions hold. Only groups whose bound qualifies are opened for each other.
4. An opened group and the sets that query it are compared by their whole sets: shared tokens are
   counted for all of them at once, and give the exact similarity.

Nothing is sketched, sampled or capped: the result is that of comparing all pairs. A group of more than BLOCK_ROWS
sets or BLOCK_TOKENS tokens is compared block by block, in tasks of their own, so that no task holds
an unbounded group. Copies of a set are dropped where they are read, but for one a piece of some megabytes.

Defined results
- Null or empty texts, and texts of signs alone, have no set and no partner. A text of fewer
  than n words is the set of one run. Very long texts are read whole; a text is the least unit of a task.
- Rows with a null doc_id have no partner. An empty table gives an empty result.
- Repeated rows (one doc_id) are one document; if their texts differ, each is compared, never with its own kind. Where
  such a document is the least of several classes, they have one name and share their links.
- In `pairs`, doc_a < doc_b. Documents with equal sets are tied to the least doc_id of them
  (jaccard 1), and that one stands for them in other pairs; `expand` lists all pairs instead.
- Ties can't arise: similarities are compared as whole numbers, and one that equals the threshold counts.
- Other columns, whatever their names, are ignored, and kept by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import common
from lodestar.llm.text import Words, mix, ngrams

N, THRESHOLD = 3, 0.5
LEAST = 0.25  # of the tokens that similar sets share, the part that has to be among the first ones
BLOCK_ROWS, BLOCK_TOKENS, PART_TOKENS, ASKS = 2_048, 2_000_000, 1_000_000, 500_000
LIGHT = 48  # bits of a token
ENTRY = pa.schema([("doc", pa.int64()), ("size", pa.int64()), ("mark_a", pa.int64()), ("mark_b", pa.int64()), ("grp", pa.int64())])
PACKET = pa.schema([("part", pa.int32()), ("groups", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])
HITS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("k", pa.int64())])
SHIPPED = pa.schema([("grp", pa.int64()), ("doc", pa.int64()), ("mark", pa.int64()), ("text", pa.string())])
LINKS = pa.schema([("doc", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
PAIRS = pa.schema([("doc_a", pa.int64()), ("doc_b", pa.int64()), ("jaccard", pa.float64())])


def token_sets(texts: pa.Array, n: int, most: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of 48 bits, offsets): the sorted set of each text's n-grams."""
    tokens, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(0, len(texts), most):  # the number of a text has 16 bits
        part = texts.slice(k, most)
        text, h = ngrams(Words(part, fold=True), n)
        key = np.sort((text.astype(np.uint64) << np.uint64(LIGHT)) | (h >> np.uint64(64 - LIGHT)))
        if len(key):
            key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        tokens.append((key & np.uint64((1 << LIGHT) - 1)).astype(np.int64))
        sizes.append(np.bincount((key >> np.uint64(LIGHT)).astype(np.int64), minlength=len(part)))
    return np.concatenate(tokens), np.concatenate((np.zeros(1, np.int64), np.cumsum(np.concatenate(sizes))))


def _mark(tokens: np.ndarray, off: np.ndarray, seed: int) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens.astype(np.uint64) + np.uint64(seed)))))
    return (sums[off[1:]] - sums[off[:-1]]).view(np.int64)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc is not null and text is not null")


def _classes(source: DataFrame, n: int, bits: int) -> np.ndarray:
    """How frequent the tokens of each of 2**bits buckets are, as a class from 0 up. This array is all that is sent
    to the driver and the tasks: 4 MB at most, whatever the input. Any order of tokens is right; this one makes the matrix lean.

    A task counts its tokens, up to 255 a bucket, and sends its counts in slices, which are summed up as they come.
    """
    size = 1 << bits
    step = min(size, 1 << 16)
    schema = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int32)
        for batch in common.pieces(batches, 0):
            np.add.at(total, token_sets(batch.column(0), n)[0] & (size - 1), 1)
        packed = np.minimum(total, 255).astype(np.uint8)
        yield common.rows([range(size // step), [packed[k : k + step].tobytes() for k in range(0, size, step)]], schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                have = held.setdefault(k, np.zeros(step, np.int64))
                have += np.frombuffer(body.as_buffer(), np.uint8)
        for k, have in held.items():  # twice the logarithm fits in a byte
            yield common.rows([[k], [(np.floor(2 * np.log2(np.maximum(have, 1))).astype(np.uint8) + (have > 0)).tobytes()]], schema)

    form = "slice int, counts binary"
    got = source.select("text").mapInArrow(count, form).repartition("slice").mapInArrow(add, form).toArrow().to_pydict()
    level = np.zeros(size, np.int64)
    for k, body in zip(got["slice"], got["counts"], strict=True):
        level[k * step : (k + 1) * step] = np.frombuffer(body, np.uint8)
    mean = np.where(level > 0, 2 ** ((level - 1) / 2), 0).mean()
    return np.clip(level - 1 - int(2 * np.log2(max(mean, 1))), 0, 100).astype(np.int8)


def _ordered(tokens: np.ndarray, off: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, rarest first in each row; row of each; group of each row)"""
    have = np.diff(off)
    row = np.repeat(np.arange(len(have)), have)
    c = classes[tokens & (len(classes) - 1)]
    by = np.argsort((row.astype(np.int64) << 8) | c, kind="stable")  # tokens are sorted within a row
    tokens, c = tokens[by], c[by]
    full = have > 0
    middle = np.zeros(len(have), np.int8)
    middle[full] = c[(off[:-1] + have // 2)[full]]
    first = np.full(len(have), len(tokens))
    f = np.flatnonzero(c == middle[row])
    np.minimum.at(first, row[f], f)
    group = np.zeros(len(have), np.int64)
    group[full] = (tokens[first[full]] << 8) | np.floor(np.log2(have[full])).astype(np.int64)
    return tokens, row, group


def _entries(source: DataFrame, n: int, classes: np.ndarray) -> DataFrame:
    """(doc, size, mark_a, mark_b, grp) of each document that has a set; the marks are 128 bits of the set."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, off = token_sets(batch.column(1), n)
        group = _ordered(tokens, off, classes)[2]
        out = common.rows([common.longs(batch.column(0)), np.diff(off), _mark(tokens, off, 1), _mark(tokens, off, 0x5851F42D4C957F2D), group], ENTRY)
        return out.filter(pa.array(np.diff(off) > 0))

    return common.map_arrow(source, kernel, ENTRY)


def _least(size, threshold: float):
    """How many tokens a set of this size shares, among the first ones, with a similar set at least."""
    return np.maximum(np.ceil(LEAST * np.ceil(threshold * size - 1e-9)), 1).astype(np.int64)


def _packets(source: DataFrame, n: int, threshold: float, classes: np.ndarray, parts: int) -> DataFrame:
    """The matrix: which groups hold which tokens, in parts by token. (part, groups, counts, tokens): as many of
    the tokens, in turn, as counts says belong to each of groups.

    A set of s tokens shares need = ceil(threshold * s) with a similar one. Its first s - need + least are sent. Of the
    shared tokens, at most need - least come after these, and they are the last ones; so at least the smaller `least`
    of both sets are among the first of both. Sets of one group that are read together send a token once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, 0, 8 << 20):
            tokens, off = token_sets(batch.column(0), n)
            tokens, row, group = _ordered(tokens, off, classes)
            have = np.diff(off)
            first = have - np.ceil(threshold * have - 1e-9).astype(np.int64) + _least(have, threshold)
            inside = np.arange(len(tokens)) - off[:-1][row] < np.minimum(first, have)[row]
            names, owner, count = np.unique(group, return_inverse=True, return_counts=True)
            tokens, owner = tokens[inside], owner[row[inside]]
            several = count[owner] > 1
            by = np.lexsort((tokens[several], owner[several]))
            t, o = tokens[several][by], owner[several][by]
            new = np.append(True, (t[1:] != t[:-1]) | (o[1:] != o[:-1]))[: len(t)]
            tokens, owner = np.concatenate((tokens[~several], t[new])), np.concatenate((owner[~several], o[new]))
            part = tokens % parts
            by = np.argsort(part.astype(np.uint16) if parts < 65_536 else part, kind="stable")
            part, owner, tokens = part[by], owner[by], (tokens[by] >> 16).astype(np.uint32).view(np.int32)
            if not len(part):
                continue
            fresh = np.append(True, part[1:] != part[:-1])
            head = np.flatnonzero(fresh | np.append(True, owner[1:] != owner[:-1]))
            ends = np.append(np.flatnonzero(fresh), len(part))
            lists = np.searchsorted(head, ends)
            sizes = np.diff(np.append(head, len(part)))
            as_lists = lambda off, values: pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array(part[fresh].astype(np.int32)), as_lists(lists, names[owner[head]]), as_lists(lists, sizes.astype(np.int32)), as_lists(ends, tokens)], schema=PACKET)

    return source.select("text").mapInArrow(run, "part int, groups array<bigint>, counts array<int>, tokens array<int>")


def _later(length: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (left, right) of all pairs within runs of these lengths that lie one after the other, some at a time."""
    end = np.repeat(np.cumsum(length), length)
    rest = end - np.arange(len(end)) - 1
    done = np.cumsum(rest)
    low = 0
    while low < len(rest):
        high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + most, side="right")))
        r = rest[low:high]
        left = np.repeat(np.arange(low, high), r)
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(r) - r, r)
        low = high


def _match(threshold: float):
    span = int(np.ceil(np.log2(1 / threshold)))

    def run(table: pa.Table) -> pa.Table:
        """(a, b, k): how many of this part's tokens two groups share, for groups whose sizes allow similar sets."""
        flat = lambda name: table.column(name).combine_chunks().flatten().to_numpy()
        names, owner = np.unique(flat("groups"), return_inverse=True)
        owner = np.repeat(owner, flat("counts"))
        key = np.unique((flat("tokens").view(np.uint32).astype(np.uint64) << np.uint64(32)) | owner.astype(np.uint64))
        token, owner = key >> np.uint64(32), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(key) else np.zeros(0, np.int64)
        length = np.diff(np.append(start, len(key)))
        owner, length = owner[np.repeat(length > 1, length)], length[length > 1]
        power = names & 255
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for left, right in _later(length):
            a, b = owner[left], owner[right]
            near = np.abs(power[a] - power[b]) <= span
            u, k = np.unique(a[near] * len(names) + b[near], return_counts=True)
            codes, inverse = np.unique(np.concatenate((codes, u)), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate((counts, k)), minlength=len(codes)).astype(np.int64)
        return pa.Table.from_arrays([pa.array(names[codes // len(names)] if len(codes) else codes), pa.array(names[codes % len(names)] if len(codes) else codes), pa.array(counts)], schema=HITS)

    return run


def _members(source: DataFrame, n: int, classes: np.ndarray) -> DataFrame:
    """(grp, doc, mark, text): each text with its group; of equal sets that are read together the least doc."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, off = token_sets(batch.column(1), n)
        group, mark, doc = _ordered(tokens, off, classes)[2], _mark(tokens, off, 1), common.longs(batch.column(0))
        by = np.lexsort((doc, mark, group))
        by = by[np.diff(off)[by] > 0]
        by = by[np.append(True, (mark[by][1:] != mark[by][:-1]) | (group[by][1:] != group[by][:-1]))[: len(by)]]
        return pa.RecordBatch.from_arrays([pa.array(group[by]), pa.array(doc[by]), pa.array(mark[by]), batch.column(1).take(pa.array(by))], schema=SHIPPED)

    return common.map_arrow(source, kernel, SHIPPED)


def _asking(texts: DataFrame, n: int) -> DataFrame:
    """(grp, doc, mark, text) for (doc, text, grp, mark), without texts of another mark, as a doc_id may have several."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, off = token_sets(batch.column(1), n)
        out = pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), batch.column(3), batch.column(1)], schema=SHIPPED)
        return out.filter(pa.array(_mark(tokens, off, 1) == common.longs(batch.column(3))))

    return common.map_arrow(texts, kernel, SHIPPED)


def _shared(row: np.ndarray, length: np.ndarray, task: np.ndarray, local: np.ndarray, rows: np.ndarray, mine: np.ndarray, inside: np.ndarray, threshold: float, size: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """(left row, right row, shared tokens) of the similar pairs of each task.

    row: the rows that hold each token that two rows of a task share, token by token; length: how many hold it.
    A task compares its first `mine` rows with the others, and where inside with each other.
    """
    run_task = task[row[np.cumsum(length) - length]]
    found = []

    def similar(left: np.ndarray, right: np.ndarray, k: np.ndarray) -> None:
        ok = k * (1 + threshold) >= threshold * (size[left] + size[right]) - 1e-6
        found.append((left[ok], right[ok], k[ok]))

    # Small tasks all at once: a square of counters each.
    few = rows[run_task] < 24
    if few.any():
        r, l = row[np.repeat(few, length)], length[few]
        small = np.flatnonzero(rows < 24)
        base = np.zeros(len(rows), np.int64)
        ends = np.cumsum(rows[small] ** 2)
        base[small] = ends - rows[small] ** 2
        total = np.zeros(int(ends[-1]), np.int32)
        for left, right in _later(l):
            a, b = r[left], r[right]
            t = task[a]
            ok = (local[a] < mine[t]) & (inside[t] | (local[b] >= mine[t]))
            np.add.at(total, (base[t] + local[a] * rows[t] + local[b])[ok], 1)
        code = np.flatnonzero(total)
        t = small[np.searchsorted(ends, code, side="right")]
        code_in = code - base[t]
        similar(start[t] + code_in // rows[t], start[t] + code_in % rows[t], total[code])
    # Large ones: tokens that many rows hold by a product of matrices, the others pair by pair.
    ends = np.cumsum(length)
    for t in np.unique(run_task[~few]):
        runs = np.arange(*np.searchsorted(run_task, [t, t + 1]))
        n, m = int(rows[t]), int(mine[t])
        count = np.zeros((m, n), np.float32)
        often = length[runs] * 16 >= n
        dense = runs[often]
        for k in range(0, len(dense), 1024):
            part = dense[k : k + 1024]
            at = np.repeat(ends[part] - length[part], length[part]) + np.arange(length[part].sum()) - np.repeat(np.cumsum(length[part]) - length[part], length[part])
            x = np.zeros((n, len(part)), np.float32)
            x[local[row[at]], np.repeat(np.arange(len(part)), length[part])] = 1
            count += x[:m] @ x.T
        rare = runs[~often]
        at = np.repeat(ends[rare] - length[rare], length[rare]) + np.arange(length[rare].sum()) - np.repeat(np.cumsum(length[rare]) - length[rare], length[rare])
        one = local[row[at]]
        for left, right in _later(length[rare]):
            a, b = one[left], one[right]
            ok = a < m
            np.add.at(count.reshape(-1), a[ok] * n + b[ok], 1)
        s = size[start[t] : start[t] + n]
        for k in range(0, m, 256):
            c = count[k : k + 256]
            ok = (c > 0) & (c * (1 + threshold) >= threshold * (s[k : k + 256][:m - k, None] + s[None, :]) - 1e-3)
            i, j = np.nonzero(ok)
            keep = (j > i + k) if inside[t] else (j >= m)
            i, j = i[keep], j[keep]
            similar(start[t] + k + i, start[t] + j, c[i, j].astype(np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, np.int64) for _ in range(3))


def _compare(threshold: float, n: int, pairs: bool):
    def run(table: pa.Table) -> pa.Table:
        grp, task, side, inside, doc, mark = (table.column(c).to_numpy() for c in ("grp", "task", "side", "inside", "doc", "mark"))
        by = np.lexsort((doc, mark, side, task, grp))
        differs = lambda *columns: np.append(True, np.logical_or.reduce([c[by][1:] != c[by][:-1] for c in columns]))[: len(by)]
        by = by[differs(grp, task, side, mark)]
        number = np.cumsum(differs(grp, task)) - 1
        by = by[np.bincount(number)[number] > 1]
        if not len(by):
            return (PAIRS if pairs else LINKS).empty_table()
        head = differs(grp, task)
        start = np.flatnonzero(head)
        rows = np.diff(np.append(start, len(by)))
        number = np.cumsum(head) - 1
        local = np.arange(len(by)) - start[number]
        mine = np.bincount(number, side[by] == 0, minlength=len(start)).astype(np.int64)
        tokens, off = token_sets(table.column("text").combine_chunks().take(pa.array(by)), n)
        size, doc = np.diff(off), doc[by]
        row = np.repeat(np.arange(len(by)), size)
        key = mix(tokens.astype(np.uint64) + number[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        length = np.diff(np.append(new, len(key)))
        row, length = row[order[np.repeat(length > 1, length)]], length[length > 1]
        # Token by token, those of a task together.
        of = number[row[np.cumsum(length) - length]]
        by_task = np.argsort(of, kind="stable")
        at = np.repeat((np.cumsum(length) - length)[by_task], length[by_task]) + np.arange(length.sum()) - np.repeat(np.cumsum(length[by_task]) - length[by_task], length[by_task])
        a, b, k = _shared(row[at], length[by_task], number, local, rows, mine, inside[by][start], threshold, size, start)
        ok = doc[a] != doc[b]
        a, b, k = a[ok], b[ok], k[ok]
        if pairs:
            return pa.Table.from_arrays([pa.array(np.minimum(doc[a], doc[b])), pa.array(np.maximum(doc[a], doc[b])), pa.array(k / (size[a] + size[b] - k))], schema=PAIRS)
        links = np.bincount(a, minlength=len(doc)) + np.bincount(b, minlength=len(doc))
        root, hit = common.roots(len(doc), a, b), np.flatnonzero(links)
        return pa.Table.from_arrays([pa.array(doc[hit]), pa.array(doc[root[hit]]), pa.array(links[hit])], schema=LINKS)

    return run


def _join(docs: DataFrame, n: int, threshold: float, pairs: bool, block_rows: int, block_tokens: int, asks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(what is found between classes: (doc_a, doc_b, jaccard), or the sums (doc, root, links) of each task;
    classes (class_id, copies); members (doc_id, class_id))"""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("threshold must be in (0, 1] and n at least 1")
    source = _source(docs)
    order = _classes(source, n, int(np.clip(np.ceil(np.log2(16 * max(source.count(), 1))), 10, 22)))
    marks = ["size", "mark_a", "mark_b"]
    entries = common.cut(_entries(source, n, order).distinct())
    classes = common.cut(entries.groupBy(*marks).agg(F.min("doc").alias("class_id"), F.first("grp").alias("grp"), F.count("*").alias("copies")))
    stats = classes.groupBy("grp").agg(F.count("*").alias("sets"), F.sum("size").alias("tokens"), F.min("size").alias("least"))
    every = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(1, -(-every // PART_TOKENS))
    match = _match(threshold)
    hits = _packets(source, n, threshold, order, parts).groupBy("part").applyInArrow(lambda t: match(t), "a long, b long, k long")
    hits = hits.groupBy("a", "b").agg(F.sum("k").alias("k"))
    need = F.ceil(LEAST * F.ceil(F.lit(threshold) * F.least("least_a", "least_b") - 1e-9))
    side = lambda s: stats.select(F.col("grp").alias(s), F.col("tokens").alias(f"tokens_{s}"), F.col("least").alias(f"least_{s}"))
    # One less, as two tokens of a set may have the same 32 bits.
    opened = hits.join(side("a"), "a").join(side("b"), "b").where(F.col("k") >= F.greatest(need - 1, F.lit(1)))
    a_asks = F.col("tokens_a") < F.col("tokens_b")  # the lesser group queries the other
    opened = opened.select(F.when(a_asks, F.col("a")).otherwise(F.col("b")).alias("own"), F.when(a_asks, F.col("b")).otherwise(F.col("a")).alias("grp"))
    queries = common.cut(opened.join(classes.select(F.col("grp").alias("own"), F.col("class_id").alias("doc"), "size", F.col("mark_a").alias("mark")), "own").select("grp", "doc", "mark", "size"))
    asked = queries.groupBy("grp").agg(F.count("*").alias("asking"), F.sum("size").alias("ask_tokens"))
    blocks = lambda rows, tokens: F.greatest(F.ceil(F.col(rows) / block_rows), F.ceil(F.col(tokens) / block_tokens)).cast("int")
    # Groups of several blocks. There are no more of them than blocks that the corpus fills.
    hot = stats.join(asked, "grp", "left").select("grp", blocks("sets", "tokens").alias("nb"), F.coalesce(blocks("asking", "ask_tokens"), F.lit(0)).alias("nq")).where("nb > 1 or nq > 1")
    hot = common.cut(hot)

    def placed(rows: DataFrame, k: str, tasks: str) -> DataFrame:
        out = rows.join(F.broadcast(hot), "grp", "left").withColumn("k", F.expr(k)).withColumn("at", F.explode(F.expr(tasks)))
        return out.select("grp", "at.task", "at.side", "at.inside", "doc", "mark", "text")

    cold = "array(named_struct('task', 0, 'side', {side}, 'inside', true))"
    between = "transform(sequence(0, nb - 1), o -> named_struct('task', least(o, k) * nb + greatest(o, k), 'side', if(k <= o, 0, 1), 'inside', o = k))"
    facing = "transform(sequence(0, nq - 1), q -> named_struct('task', nb * nb + k * nq + q, 'side', 0, 'inside', false))"
    asking = "transform(sequence(0, nb - 1), b -> named_struct('task', nb * nb + b * nq + k % nq, 'side', 1, 'inside', false))"
    own = placed(_members(source, n, order), "cast(coalesce(pmod(mark, nb), 0) as int)", f"case when nb is null then {cold.format(side=0)} when nq = 0 then {between} else concat({between}, {facing}) end")
    # Beyond `asks` queries, which take some 100 bytes each, their texts are found by a join of both sides.
    few = queries.count() <= asks
    texts = _asking(source.join(F.broadcast(queries) if few else queries.hint("shuffle_hash"), "doc").select("doc", "text", "grp", "mark"), n)
    theirs = placed(texts, "cast(pmod(xxhash64(mark), 1 << 30) as int)", f"case when nb is null then {cold.format(side=1)} else {asking} end")
    buckets = max(1, -(-(every + (queries.agg(F.sum("size")).first()[0] or 0)) // PART_TOKENS))
    tasks = own.unionByName(theirs).withColumn("bucket", F.pmod(F.xxhash64("grp", "task"), F.lit(buckets)))
    compare = _compare(threshold, n, pairs)
    found = tasks.groupBy("bucket").applyInArrow(lambda t: compare(t), "doc_a long, doc_b long, jaccard double" if pairs else "doc long, root long, links long")
    members = entries.join(classes.select(*marks, "class_id"), marks).select(F.col("doc").alias("doc_id"), "class_id")
    return found, classes.groupBy("class_id").agg(F.sum("copies").alias("copies")), members


def pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, expand: bool = False, block_rows: int = BLOCK_ROWS, block_tokens: int = BLOCK_TOKENS, asks: int = ASKS) -> DataFrame:
    """(doc_a, doc_b, jaccard) as the module says."""
    found, _, members = _join(docs, n, threshold, True, block_rows, block_tokens, asks)
    if not expand:
        copies = members.where("class_id <> doc_id").select(F.col("class_id").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
        return found.unionByName(copies).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))
    l, r = members.select(F.col("class_id").alias("doc_a"), F.col("doc_id").alias("x")), members.select(F.col("class_id").alias("doc_b"), F.col("doc_id").alias("y"))
    every = found.join(l, "doc_a").join(r, "doc_b").select("x", "y", "jaccard")
    every = every.unionByName(l.join(r, F.col("doc_a") == F.col("doc_b")).where("x < y").select("x", "y", F.lit(1.0).alias("jaccard")))
    return every.where("x <> y").groupBy(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).agg(F.max("jaccard").alias("jaccard"))


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS, block_tokens: int = BLOCK_TOKENS, asks: int = ASKS) -> DataFrame:
    """(doc_id, class_id, copies, links, group_id): a row for each document that has a partner.

    class_id: the least doc_id of the documents with an equal set, and copies their number; links: how many other
    classes are similar to it; group_id: the least doc_id that a chain of links leads to. A document with several
    texts has the least class_id, the most copies and all links of them.
    """
    found, sizes, members = _join(docs, n, threshold, False, block_rows, block_tokens, asks)
    found = common.cut(found)
    links = found.groupBy(F.col("doc").alias("class_id")).agg(F.sum("links").alias("links"))
    roots = common.components(docs.sparkSession, found.select(F.col("doc").alias("a"), F.col("root").alias("b")))
    roots = roots.select(F.col("node").alias("class_id"), F.col("root").alias("group_id"))
    each = sizes.join(links, "class_id", "left").join(roots, "class_id", "left").where("copies > 1 or links > 0")
    out = members.join(each.select("class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "class_id").alias("group_id")), "class_id")
    return out.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("copies").alias("copies"), F.sum("links").alias("links"), F.min("group_id").alias("group_id"))


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, **options) -> DataFrame:
    """docs, with all columns, without those that a chain of pairs leads to from a document of a lesser doc_id.

    Rows with a null doc_id and documents without a partner stay; rows that repeat a doc_id stay or go together.
    """
    gone = classes(docs, n, threshold, **options).where("doc_id <> group_id").select(F.col("doc_id").alias("gone"))
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["gone"], "left_anti")
