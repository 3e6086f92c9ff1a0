"""Mixing to target weights (operator 7): soft membership and nonnegative document rates.

1. A classifier learns domains from the table of labels: "toxic", and "high" and "low" quality of
   the rest. It is a softmax regression over hashed words (their sums by the root of their number) and the text's shape, trained in
   numpy on at most `max_labelled` labelled documents (those of the least hashes), and gives
   every document of the corpus its posteriors p.
2. Document i of n_i words gets a rate r_i >= 0, the times that it should be seen. The expected
   words of domain k are sum_i n_i p_ik r_i; the rates minimise their squared distance to
   weight_k * all words, each domain's by its mass. Projected gradient descent starts at rates
   of 1, so rates stay as near to 1 as the steps allow, and equal posteriors have equal rates.
3. Each step is one aggregate over all documents. A rate follows from the posteriors and the steps'
   gradients so far, which are a few numbers, so tasks compute it anew and nothing is joined or stored.

Defined results
- Null and empty texts have no words: they take no part in the fit and have rate 1.
- Rows with a null doc_id are left out of `rates`, but are fitted and kept by `mix`.
- Repeated rows count as often as they occur; `rates` lists them once, with their largest rate.
- Without labels all domains are equally likely; with labels of one domain, it is nearly certain. Weights are scaled to sum to 1.
- Labels with a null doc_id or null class are ignored; of several for one document the largest counts.
- Other columns are ignored, and kept by `mix`, which adds rate and copies (replacing columns of these names).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import common
from lodestar.llm.text import Words, mix as scramble, text_bytes

DOMAINS = ("high", "low", "toxic")
WEIGHTS = {"high": 0.9, "low": 0.1, "toxic": 0.0}
MAX_LABELLED, BUCKETS, ROUNDS, STEPS, TOLERANCE = 4_000, 1 << 13, 150, 60, 1e-7
SHAPE = 12

CLASS = np.full(256, 6, np.uint8)  # beyond ASCII
CLASS[:128] = 4
for _c in range(128):
    if chr(_c).islower():
        CLASS[_c] = 0
    elif chr(_c).isupper():
        CLASS[_c] = 1
    elif chr(_c).isdigit():
        CLASS[_c] = 2
CLASS[[9, 13, 32]] = 3
CLASS[10] = 5


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shape features, hash buckets of the words, offsets of each text's words)"""
    data, at = text_bytes(texts)
    n = len(at) - 1
    kinds = CLASS[data]
    size = np.diff(at)
    full = np.flatnonzero(size)
    counts = np.zeros((n, 7))
    for c in range(7):
        if len(full):
            counts[full, c] = np.add.reduceat(kinds == c, at[full], dtype=np.int64)
    words = Words(texts, fold=True)
    text = words.text_of()
    key = np.sort((text.astype(np.uint64) << np.uint64(40)) | (words.hash >> np.uint64(24)))
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n)
    have = np.diff(words.off)
    length = np.bincount(text, words.end - words.start, minlength=n)
    share = counts / np.maximum(size, 1)[:, None]
    shape = np.column_stack((np.ones(n), share[:, 1:], np.log1p(have) / 8, distinct / np.maximum(have, 1), length / np.maximum(have, 1) / 10, share[:, 4] > 0.1, have < 10))
    return shape[:, :SHAPE], (scramble(words.hash) & np.uint64(BUCKETS - 1)).astype(np.int64), words.off


@dataclass
class Classifier:
    shape: np.ndarray
    words: np.ndarray

    def posteriors(self, shape: np.ndarray, buckets: np.ndarray, off: np.ndarray) -> np.ndarray:
        z = shape @ self.shape + _sums(self.words[buckets], off)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values of each text's words, by the square root of their number."""
    out = np.zeros((len(off) - 1, values.shape[1]))
    have = np.diff(off)
    full = np.flatnonzero(have)
    if len(full):
        out[full] = np.add.reduceat(values, off[full], axis=0, dtype=np.float64) / np.sqrt(have[full, None])
    return out


def train(shape: np.ndarray, buckets: np.ndarray, off: np.ndarray, label: np.ndarray, rounds: int = ROUNDS) -> Classifier:
    """Softmax regression by Adam over all rows at once, with a little weight decay."""
    k, n = len(DOMAINS), len(label)
    m = Classifier(np.zeros((SHAPE, k)), np.zeros((BUCKETS, k)))
    gold = np.eye(k)[label]
    row = np.repeat(np.arange(n), np.diff(off))
    per_word = 1.0 / np.sqrt(np.maximum(np.diff(off), 1))[row]
    state = [[np.zeros_like(a), np.zeros_like(a)] for a in (m.shape, m.words)]
    for step in range(1, rounds + 1):
        d = (m.posteriors(shape, buckets, off) - gold) / n
        spread = np.column_stack([np.bincount(buckets, d[row, c] * per_word, minlength=BUCKETS) for c in range(k)])
        for a, g, (u, v), decay in ((m.shape, shape.T @ d, state[0], 1e-4), (m.words, spread, state[1], 1e-7)):
            g = g + decay * a
            u += 0.1 * (g - u)
            v += 0.01 * (g * g - v)
            a -= 0.2 * (1 - step / (rounds + 1)) * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return m


def fit_classifier(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Classifier:
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.when(F.col("toxic") > 0, 2).when(F.col("quality") > 0, 0).when(F.col("quality") <= 0, 1).alias("domain")).where("id is not null and domain is not null")
    known = known.groupBy("id").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sample = source.join(F.broadcast(known), "id").select("id", "text", "domain")
    schema = pa.schema([("id", pa.int64()), ("domain", pa.int64()), ("shape", pa.list_(pa.float64())), ("buckets", pa.list_(pa.int32()))])

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        shape, buckets, off = features(batch.column(1))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(shape) + 1, dtype=np.int32) * SHAPE), pa.array(shape.ravel()))
        lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(buckets.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(common.longs(batch.column(0))), pa.array(common.longs(batch.column(2))), flat, lists], schema=schema)

    got = common.map_arrow(sample, kernel, schema).toArrow().sort_by("id").combine_chunks()
    if not got.num_rows:
        return Classifier(np.zeros((SHAPE, len(DOMAINS))), np.zeros((BUCKETS, len(DOMAINS))))
    lists = got.column("buckets").combine_chunks()
    off = lists.offsets.to_numpy().astype(np.int64)
    shape = got.column("shape").combine_chunks().flatten().to_numpy().reshape(-1, SHAPE)
    return train(shape, lists.values.to_numpy().astype(np.int64)[off[0] : off[-1]], off - off[0], got.column("domain").to_numpy())


def rates_of(p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The rates that projected gradient steps (each a vector over domains) lead to from 1."""
    r = np.ones(len(p))
    for g in steps:
        r = np.maximum(0.0, r - p @ g)
    return r


@dataclass
class Mix:
    """residual: how far the expected words are from the targets in the end, as a share of all words."""

    classifier: Classifier
    steps: np.ndarray
    soft: DataFrame | None  # (doc_id, words, posteriors)
    residual: float = 0.0

    def rates(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rate, words, posteriors)"""
        shape, buckets, off = features(texts)
        p = self.classifier.posteriors(shape, buckets, off)
        n = np.diff(off)
        return np.where(n > 0, rates_of(p, self.steps), 1.0), n, p


def fit(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, max_labelled: int = MAX_LABELLED, steps: int = STEPS, tolerance: float = TOLERANCE) -> Mix:
    goal = np.array([(weights or WEIGHTS).get(d, 0.0) for d in DOMAINS])
    if (goal < 0).any() or not goal.sum() > 0:
        raise ValueError("weights must be nonnegative, and one of them positive")
    goal = goal / goal.sum()
    k = len(DOMAINS)
    classifier = fit_classifier(docs, labels, max_labelled)
    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.int64()), *((d, pa.float64()) for d in DOMAINS)])

    def posteriors(batch: pa.RecordBatch) -> pa.RecordBatch:
        shape, buckets, off = features(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), *(pa.array(x) for x in classifier.posteriors(shape, buckets, off).T)], schema=schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    soft = common.cut(common.map_arrow(source, posteriors, schema))

    def totals(gradients: np.ndarray, squares: bool) -> np.ndarray:
        """Expected words of the domains at the rates so far; with squares, their second moments at rates of 1."""
        names = [f"x{i}" for i in range(k * k if squares else k)]

        def run(batches):
            total = np.zeros(len(names))
            for batch in batches:
                n = batch.column("words").to_numpy().astype(float)
                p = np.column_stack([batch.column(d).to_numpy() for d in DOMAINS])
                total += ((p * n[:, None]).T @ p).ravel() if squares else p.T @ (n * rates_of(p, gradients))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=names)

        row = soft.select("words", *DOMAINS).mapInArrow(run, ", ".join(f"{x} double" for x in names)).agg(*(F.sum(x).alias(x) for x in names)).first()
        return np.array([x or 0.0 for x in row])

    history = np.zeros((0, k))
    now = totals(history, False)
    every = now.sum()
    if not every:
        return Mix(classifier, history, soft)
    mass = np.maximum(now, 1e-3 * every)
    # In the metric of the words, and residuals by the domains' masses, the Hessian is at most this.
    hessian = totals(history, True).reshape(k, k) / np.sqrt(np.outer(mass, mass))
    rate = 1.0 / max(np.linalg.eigvalsh(hessian).max(), 1e-12)
    was = np.inf
    for _ in range(steps):
        residual = now - goal * every
        loss = float((residual**2 / mass).sum() / every)
        if loss < tolerance or was - loss < tolerance * was:
            break
        was = loss
        history = np.vstack((history, rate * residual / mass))
        now = totals(history, False)
    return Mix(classifier, history, soft, float(np.abs(now - goal * every).sum() / every))


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, **options) -> DataFrame:
    """(doc_id, n_words, p_high, p_low, p_toxic, rate) of each document."""
    made = fit(docs, labels, weights, **options)
    steps = made.steps
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), *((f"p_{d}", pa.float64()) for d in DOMAINS), ("rate", pa.float64())])

    def run(batches):  # from the posteriors that the fit has kept
        for batch in batches:
            n = batch.column("words").to_numpy()
            p = np.column_stack([batch.column(d).to_numpy() for d in DOMAINS])
            r = np.where(n > 0, rates_of(p, steps), 1.0)
            yield common.rows([batch.column("doc_id").to_numpy(), n, *np.round(p, 6).T, np.round(r, 6)], schema)

    form = "doc_id long, n_words long, " + "".join(f"p_{d} double, " for d in DOMAINS) + "rate double"
    out = made.soft.where("doc_id is not null").mapInArrow(run, form)
    rest = [c for c in out.columns if c != "doc_id"]
    best = F.max(F.struct("rate", *(c for c in rest if c != "rate"))).alias("best")
    return out.groupBy("doc_id").agg(best).select("doc_id", *(F.col(f"best.{c}").alias(c) for c in rest))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, **options) -> DataFrame:
    """docs whose rate isn't 0, with rate and copies: the rate rounded up or down, by chance in the proportion
    of its fraction; the chance is a hash of the row's doc_id and text, so that a rerun gives the same."""
    fitted = fit(docs, labels, weights, **options)
    made = Mix(fitted.classifier, fitted.steps, None)  # what goes to the tasks
    docs = docs.drop("rate", "copies")
    at = docs.columns.index("text")

    def run(batches):
        for batch in common.pieces(batches, at):
            r, _, _ = made.rates(batch.column(at))
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(r)], names=[*batch.schema.names, "rate"])
            yield out.filter(pa.array(r > 0))

    from pyspark.sql.types import DoubleType, StructField, StructType

    out = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("rate", DoubleType())]))
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    return out.withColumn("copies", (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")).withColumn("rate", F.round("rate", 6))
