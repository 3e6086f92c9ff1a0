"""Toxicity by lexicon induction (operator 10): random walks over a word graph give words a polarity.

1. Seed terms come from labelled documents: words whose document frequencies differ between toxic
   and clean ones beyond chance (the likelihood ratio G2 against the number of words that were
   tried), toxic ones by `lift` times at least. The labelled documents are a sample of at most
   `max_labelled` (those of the least hashes); all else covers all documents.
2. Candidates are all words of the corpus that come with toxic seeds in a document far more
   often than chance, by the same measures over all documents, but for those that clean labelled
   documents hold as well. The clean seeds are the most frequent words that don't lean to toxic documents.
   In either step all copies of a text, exact or edited, count as one text (see `_copies`), for words and for totals.
3. Nodes are the seeds and the candidates; edges are positive pointwise mutual information of
   their document frequencies. Counts are over all documents.
4. Random walks with restart from the toxic and from the clean seeds reach a node with p and q. With
   r = p / q over the median of the clean seeds, its weight is (r - 1) / (r + 1); seeds keep their side.
5. The score of a document is the sum of the positive weights of its words (clean words don't make
   up for an insult, however long the document). It is toxic from the threshold up that gives the best F1 on
   the labelled sample.

Words are folded: letters in lower case, signs as spaces. What tasks get is the lexicon and, in one
pass, the list of candidate words, whose size is checked: beyond `limit` words they are joined instead. Beyond
`most_nodes` nodes the graph's edges stay in a table, and each step of the walks is a join.
`clean_seeds` is how many clean seeds the walks start from.

Defined results
- Null and empty texts score 0 and are never toxic. A null doc_id can't be named by `toxic_documents`; `without_toxic` judges such rows alike.
- Without labels of both classes, or where no word stands out, the lexicon is empty and nothing is toxic.
- Labels with a null doc_id or class are ignored; of several for one document the largest counts.
- An empty table gives an empty result. Very long texts are read whole. Of scores that tie for the best F1 the largest sets the threshold.
- Repeated rows are scored each; `toxic_documents` gives one row for a doc_id, with the largest score.
- Other columns, whatever their names, are ignored, and kept by `without_toxic`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import common
from lodestar.llm.text import Prefix, Words, mix, ngrams

MAX_LABELLED, LIFT, CLEAN_SEEDS, RESTART, STEPS, LIMIT, MOST_NODES = 20_000, 4.0, 200, 0.15, 60, 4_000_000, 5_000
BANDS = 8
COPIES = pa.schema([("mark", pa.int64()), ("flag", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])
HOLDS = pa.schema([("mark", pa.int64()), ("flag", pa.int64()), ("word", pa.int64()), ("n", pa.int64())])
PAIRS = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("n", pa.int64()), ("word", pa.string())])


@dataclass
class Lexicon:
    hashes: np.ndarray  # int64, sorted
    weights: np.ndarray
    words: list[str]
    threshold: float = np.inf

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(score, number of words with a positive weight) of each text"""
        n = len(texts)
        if not len(self.hashes) or not n:
            return np.zeros(n), np.zeros(n, np.int64)
        words = Words(texts, fold=True)
        h = words.hash.view(np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        w = np.where(self.hashes[at] == h, np.maximum(self.weights[at], 0), 0)
        text = words.text_of()
        return np.bincount(text, w, minlength=n), np.bincount(text[w > 0], minlength=n)


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word hash, one place of it) for each distinct word of each text"""
    text = words.text_of()
    by = np.lexsort((words.hash, text))
    t, h = text[by], words.hash[by]
    new = np.append(True, (t[1:] != t[:-1]) | (h[1:] != h[:-1]))[: len(t)]
    return t[new], h[new].view(np.int64), by[new]


def _g2(a, b, n1, n0):
    """Columns: 2 * sum(O ln(O / E)) for a of n1 against b of n0."""
    ea, eb = (a + b) * n1 / (n1 + n0), (a + b) * n0 / (n1 + n0)
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    return 2 * (term(a, ea) + term(b, eb))


def _marks(words: Words) -> np.ndarray:
    """One number a text: the same for the same words in the same order."""
    return mix(Prefix(words.hash).of(words.off[:-1], words.off[1:])).view(np.int64)


def _flags(batch: pa.RecordBatch, words: Words, seeds: np.ndarray | None) -> np.ndarray:
    """0 or 1 a text: its flag or, with seeds, whether it holds one of them."""
    if seeds is None:
        return common.longs(batch.column(0))
    hit = np.zeros(batch.num_rows, np.int64)
    hit[words.text_of()[_member(seeds, words.hash.view(np.int64))]] = 1
    return hit


def _copies(df: DataFrame, seeds: np.ndarray | None = None) -> DataFrame:
    """(mark, flag, n, size): for each distinct text with words how often it is there, and how many copies of it, exact or
    edited, there are in all. A text counts 1 / size, so that a group of copies counts about once.

    Copies share one of BANDS keys, each of the least and the largest hash of a text's runs of three words under one order
    of them: texts whose runs are four fifths the same share one nearly always. df: (flag, text)
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(1), fold=True)
        marks, flags = _marks(words), _flags(batch, words, seeds)
        text, h = ngrams(words, 3)
        some = np.flatnonzero(np.diff(words.off))
        start = np.searchsorted(text, some)
        keys = []
        for k in range(BANDS if len(some) else 0):
            x = mix(h + np.uint64(k + 1))
            keys.append(mix(np.minimum.reduceat(x, start) + mix(np.maximum.reduceat(x, start) + np.uint64(k))).view(np.int64))
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        return common.rows([np.tile(marks[some], BANDS), np.tile(flags[some], BANDS), keys, np.ones(len(keys), np.int64)], COPIES)

    keyed = common.map_arrow(df, kernel, COPIES).withColumn("size", F.sum("n").over(Window.partitionBy("key")))
    return common.cut(keyed.groupBy("mark", "flag").agg((F.sum("n") / BANDS).alias("n"), F.max("size").alias("size")))


def _totals(copies: DataFrame) -> tuple[float, float]:
    """How many texts there are with flag and without it, where copies count once."""
    one = F.col("n") / F.col("size")
    with_, without = copies.agg(F.sum(one * F.col("flag")), F.sum(one * (1 - F.col("flag")))).first()
    return with_ or 0.0, without or 0.0


def _counts(df: DataFrame, copies: DataFrame, wanted: np.ndarray | None = None, seeds: np.ndarray | None = None) -> DataFrame:
    """(word, a, b): in how many texts with flag and without it each word (of those wanted) occurs, where copies count once. df: (flag, text)"""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(1), fold=True)
        marks, flags = _marks(words), _flags(batch, words, seeds)
        text, h, _ = _distinct(words)
        if wanted is not None:
            at = _member(wanted, h)
            text, h = text[at], h[at]
        return common.rows([marks[text], flags[text], h, np.ones(len(h), np.int64)], HOLDS)

    holds = common.map_arrow(df, kernel, HOLDS).groupBy("mark", "flag", "word").agg(F.sum("n").alias("k")).join(copies, ["mark", "flag"])
    one = F.col("k") / F.col("size")
    return holds.groupBy("word").agg(F.round(F.sum(one * F.col("flag")), 6).alias("a"), F.round(F.sum(one * (1 - F.col("flag"))), 6).alias("b"))


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(toxic, text) of the sample. The sample's labels are broadcast: they are `most` rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(most)
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return source.join(F.broadcast(known), "id").select((F.col("toxic") > 0).cast("int").alias("toxic"), F.coalesce("text", F.lit("")).alias("text"))


def _seeds(sample: DataFrame, lift: float, clean_seeds: int) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """(toxic seeds, clean seeds, words that labelled documents speak against)"""
    copies = _copies(sample)
    n1, n0 = _totals(copies)
    none = np.zeros(0, np.int64)
    if not n1 or not n0:
        return none, none, None
    counts = common.cut(_counts(sample, copies))
    tried = counts.count()
    bar = 2 * np.log(max(tried, 2)) + 2
    a, b = F.col("a"), F.col("b")
    toxic = counts.where((_g2(a, b, n1, n0) >= bar) & ((a + 0.5) / n1 >= lift * (b + 0.5) / n0))
    clean = counts.where((b > 0) & (a * n0 <= b * n1)).orderBy(F.desc("b"), "word").limit(clean_seeds)
    column = lambda df: np.sort(df.select("word").toArrow().column("word").to_numpy().astype(np.int64))
    against = counts.where((b > 0) & ((a + 0.5) / n1 < lift * (b + 0.5) / n0)).select("word")
    return column(toxic), column(clean), against


def _member(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _candidates(texts: DataFrame, toxic: np.ndarray, against: DataFrame, total: int, lift: float, limit: int) -> np.ndarray:
    """Words that come with toxic seeds beyond chance, over all texts."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64()), ("texts", pa.int64())])

    def with_seed(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(0), fold=True)
        text = words.text_of()
        hit = np.zeros(batch.num_rows, bool)
        hit[text[_member(toxic, words.hash.view(np.int64))]] = True
        words = Words(batch.column(0).filter(pa.array(hit)), fold=True)
        u, n = np.unique(_distinct(words)[1], return_counts=True)
        return common.rows([np.append(u, 0), np.append(n, 0), np.append(np.zeros(len(u), np.int64), hit.sum())], schema)

    near = common.map_arrow(texts, with_seed, schema, text=0)
    near = common.cut(near.groupBy("word").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")))
    hits = near.agg(F.sum("texts")).first()[0] or 0
    if not hits or hits == total:
        return toxic
    near = near.where("n > 0").join(against, "word", "left_anti").select("word", "n")
    every_text = texts.select(F.lit(0).alias("flag"), "text")
    copies = _copies(every_text, toxic)
    n1, n0 = _totals(copies)
    few = near.count()
    wanted = np.sort(near.select("word").toArrow().column("word").to_numpy().astype(np.int64)) if few <= limit else None

    def frequency(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column(0), fold=True)
        text, h = words.text_of(), words.hash.view(np.int64)
        if wanted is not None:
            at = _member(wanted, h)
            text, h = text[at], h[at]
        by = np.lexsort((h, text))
        text, h = text[by], h[by]
        new = np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1]))[: len(h)]
        u, n = np.unique(h[new], return_counts=True)
        return common.rows([u, n, np.zeros(len(u), np.int64)], schema)

    every = common.map_arrow(texts, frequency, schema, text=0).groupBy("word").agg(F.sum("n").alias("df"))
    both = near.join(every, "word").select("word", F.col("n").alias("a"), (F.col("df") - F.col("n")).alias("b"))
    a, b = F.col("a"), F.col("b")
    # A stricter bar than for seeds: what stands out against all texts may be but the language of toxic ones.
    bar = 3 * np.log(max(few, 2)) + 3
    beyond = lambda df: df.where((_g2(a, b, n1, n0) >= bar) & ((a + 0.5) / n1 >= lift * (b + 0.5) / n0))
    # Counts of all rows say which words to count again with copies as one.
    listed = np.sort(beyond(both).select("word").toArrow().column("word").to_numpy().astype(np.int64))
    out = beyond(_counts(every_text, copies, listed, toxic))
    return np.union1d(toxic, out.select("word").toArrow().column("word").to_numpy().astype(np.int64))


def walk(i: np.ndarray, j: np.ndarray, weight: np.ndarray, start: np.ndarray, restart: float, steps: int) -> np.ndarray:
    """Where random walks with restart over an undirected graph are in the end. Mass at nodes without edges restarts."""
    n = len(start)
    i, j, weight = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((weight, weight))
    degree = np.bincount(i, weight, minlength=n)
    start = start / max(start.sum(), 1)
    at = start.copy()
    for _ in range(steps):
        flow = np.bincount(j, weight * (at / np.maximum(degree, 1e-12))[i], minlength=n)
        at = (1 - restart) * flow + start * (1 - (1 - restart) * flow.sum())
    return at


def _walk_tables(counts: DataFrame, total: int, toxic: np.ndarray, clean: np.ndarray, restart: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """What walk() gives from both starts, for a graph whose edges stay in a table: a join a step, and the driver holds the nodes alone."""
    df = counts.where("i = j").select("i", F.col("n").alias("df"))
    edges = counts.where("i <> j").select("i", "j", "n").join(df.withColumnRenamed("df", "a"), "i").join(df.select(F.col("i").alias("j"), F.col("df").alias("b")), "j")
    edges = edges.select("i", "j", F.log(F.col("n") * float(total) / F.greatest(F.col("a") * F.col("b"), F.lit(1))).alias("w")).where("w > 0")
    edges = edges.unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    edges = common.cut(edges.join(edges.groupBy("i").agg(F.sum("w").alias("degree")), "i").select("i", "j", (F.col("w") / F.col("degree")).alias("w")))
    s, t = toxic / max(toxic.sum(), 1), clean / max(clean.sum(), 1)
    spark = counts.sparkSession
    start = common.cut(spark.createDataFrame(pa.table({"i": np.arange(len(s)), "s": s, "t": t})))
    now = start.select("i", F.col("s").alias("p"), F.col("t").alias("q"))
    for _ in range(steps):
        flow = common.cut(edges.join(now, "i").groupBy(F.col("j").alias("i")).agg(F.sum(F.col("w") * F.col("p")).alias("p"), F.sum(F.col("w") * F.col("q")).alias("q")))
        in_p, in_q = (x or 0.0 for x in flow.agg(F.sum("p"), F.sum("q")).first())
        keep = 1 - restart
        now = start.join(flow, "i", "left").select("i", (keep * F.coalesce("p", F.lit(0.0)) + F.col("s") * (1 - keep * in_p)).alias("p"), (keep * F.coalesce("q", F.lit(0.0)) + F.col("t") * (1 - keep * in_q)).alias("q"))
    got = now.toArrow().sort_by("i")
    return got.column("p").to_numpy(), got.column("q").to_numpy()


def induce(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, lift: float = LIFT, clean_seeds: int = CLEAN_SEEDS, restart: float = RESTART, steps: int = STEPS, limit: int = LIMIT, most_nodes: int = MOST_NODES) -> Lexicon:
    empty = Lexicon(np.zeros(0, np.int64), np.zeros(0), [])
    sample = _labelled(docs, labels, max_labelled)
    toxic, clean, against = _seeds(sample, lift, clean_seeds)
    if not len(toxic):
        return empty
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    total = texts.count()
    inner = _candidates(texts, toxic, against, total, lift, limit)
    clean = np.setdiff1d(clean, inner)
    nodes = np.union1d(inner, clean)

    def pairs(batches):
        """Pairs of nodes in a text, the smaller first, and each node with itself: one row a pair and task."""
        width, most = len(nodes), 1_000_000
        dense = np.zeros(width**2 if width <= 2000 else 0, np.int64)
        sparse = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        seen: dict[int, str] = {}
        for batch in common.pieces(batches, 0):
            words = Words(batch.column(0), fold=True)
            place = np.flatnonzero(_member(nodes, words.hash.view(np.int64)))
            text, node = words.text_of()[place], np.searchsorted(nodes, words.hash[place].view(np.int64))
            key = np.unique(text * width + node)
            for k, p in zip(*np.unique(node, return_index=True), strict=True):
                if int(k) not in seen:
                    seen[int(k)] = words.slice(place[p], place[p] + 1)[0].decode("utf-8", "replace")
            text, node = key // width, key % width
            size = np.bincount(text, minlength=batch.num_rows)
            rest = np.repeat(np.cumsum(size), size) - np.arange(len(text))
            done = np.cumsum(rest)
            low = 0
            while low < len(rest):  # some pairs at a time
                high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + most, side="right")))
                r = rest[low:high]
                left = np.repeat(np.arange(low, high), r)
                right = left + np.arange(len(left)) - np.repeat(np.cumsum(r) - r, r)
                codes = node[left] * width + node[right]
                if len(dense):
                    np.add.at(dense, codes, 1)
                else:
                    u, n = np.unique(codes, return_counts=True)
                    both = np.concatenate((sparse[0], u))
                    u, inverse = np.unique(both, return_inverse=True)
                    sparse = (u, np.bincount(inverse, np.concatenate((sparse[1], n))).astype(np.int64))
                low = high
        if len(dense):
            at = np.flatnonzero(dense)
            sparse = (at, dense[at])
        for k in range(0, len(sparse[0]), 100_000):
            c = sparse[0][k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(c // width), pa.array(c % width), pa.array(sparse[1][k : k + 100_000]), pa.nulls(len(c), pa.string())], schema=PAIRS)
        names = sorted(seen)
        yield common.rows([names, [-1] * len(names), [0] * len(names), [seen[k] for k in names]], PAIRS)

    is_toxic, is_clean = np.isin(nodes, toxic).astype(float), np.isin(nodes, clean).astype(float)
    counts = common.cut(texts.mapInArrow(pairs, "i long, j long, n long, word string").groupBy("i", "j").agg(F.sum("n").alias("n"), F.max("word").alias("word")))
    shown = [""] * len(nodes)
    named = counts.where("j < 0").toArrow()
    for k, w in zip(named.column("i").to_pylist(), named.column("word").to_pylist(), strict=True):
        shown[k] = w
    if len(nodes) <= most_nodes:
        got = counts.where("j >= 0").select("i", "j", "n").toArrow()
        i, j, n = (got.column(c).to_numpy().astype(np.int64) for c in ("i", "j", "n"))
        own = i == j
        df = np.zeros(len(nodes))
        df[i[own]] = n[own]
        i, j, n = i[~own], j[~own], n[~own]
        pmi = np.log(n * total / np.maximum(df[i] * df[j], 1))
        i, j, pmi = i[pmi > 0], j[pmi > 0], pmi[pmi > 0]
        p, q = (walk(i, j, pmi, start, restart, steps) for start in (is_toxic, is_clean))
    else:
        p, q = _walk_tables(counts.where("j >= 0"), total, is_toxic, is_clean, restart, steps)
    # Odds against those of a typical clean seed, as frequent words are near to all. Seeds keep their side.
    odds = (p + 1e-12) / (q + 1e-12)
    odds = odds / max(float(np.median(odds[np.isin(nodes, clean)])), 1e-12) if len(clean) else odds
    weight = (odds - 1) / (odds + 1)
    weight = np.where(np.isin(nodes, clean), np.minimum(weight, 0), np.where(np.isin(nodes, toxic), np.maximum(weight, 0), weight))
    made = Lexicon(nodes, weight, shown)
    made.threshold = _threshold(sample, made)
    return made


def _threshold(sample: DataFrame, lexicon: Lexicon) -> float:
    """Midway below the least score of the best F1 on the sample."""
    schema = pa.schema([("score", pa.float64()), ("toxic", pa.int64())])

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        return common.rows([lexicon.score(batch.column(1))[0], common.longs(batch.column(0))], schema)

    got = common.map_arrow(sample, kernel, schema).groupBy(F.round("score", 6).alias("score")).agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).orderBy(F.desc("score")).toArrow().to_pandas()
    hit, all_ = np.cumsum(got.k.to_numpy(float)), np.cumsum(got.n.to_numpy(float))
    score = got.score.to_numpy(float)
    f1 = np.where(score > 0, 2 * hit / (all_ + hit[-1]), -1)
    if f1.max() <= 0:
        return np.inf
    best = int(np.argmax(f1))
    return (score[best] + (score[best + 1] if best + 1 < len(score) else 0)) / 2


def toxic_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, score, toxic_words) of each document that is toxic."""
    lexicon = induce(docs, labels, **options)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("toxic_words", pa.int64())])

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        score, hits = lexicon.score(batch.column(1))
        at = np.flatnonzero(score >= lexicon.threshold)
        return common.rows([common.longs(batch.column(0))[at], np.round(score[at], 6), hits[at]], schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return common.map_arrow(source, kernel, schema).groupBy("doc_id").agg(F.max("score").alias("score"), F.max("toxic_words").alias("toxic_words"))


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs, with all columns, without the toxic rows."""
    lexicon = induce(docs, labels, **options)
    at = docs.columns.index("text")

    def run(batches):
        for batch in common.pieces(batches, at):
            yield batch.filter(pa.array(lexicon.score(batch.column(at))[0] < lexicon.threshold))

    return docs.mapInArrow(run, docs.schema)
