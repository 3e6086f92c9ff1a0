"""Language identification (operator 4): a bidirectional gated recurrent network over bytes, in numpy.

The network is trained here by backpropagation through time on windows of labelled documents, drawn at hashed
places of whole texts: of each language, the `per_language` distinct texts with the least hashes (see
common.training_windows). It labels every byte of a text with probabilities; a document's are the mean
logarithms of these, pooled over all its bytes.

Whole texts are cut into windows that overlap by `MARGIN` bytes; each byte counts in the window that has it in
its core. The network goes to the tasks (some 60 KB); the pass over the documents is narrow.

Defined results
- Null and empty texts, and those of white space alone, have language "und" and confidence 0.
- Rows with a null doc_id are left out. Repeated rows give one result; if their texts differ, the one with the largest confidence counts.
- Labels that are null are ignored; without labels every text is "und". Ties go to the first language by name.
- Very long texts are read whole, window by window. An empty table gives an empty result.
- Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import common
from lodestar.llm.pii import squash
from lodestar.llm.text import SPACE, text_bytes

HIDDEN, WIDTH, MARGIN, ROUNDS, SEED = 10, 256, 16, 250, 5
PER_LANGUAGE, WINDOWS, TRAINED = 300, 12, 64  # labelled texts of each language, windows of each, bytes of a window
SCHEMA = pa.schema([("doc_id", pa.int64()), ("language", pa.string()), ("confidence", pa.float64())])


@dataclass
class Network:
    """Of each direction: table, from bytes to the gates z and r and to the candidate; inner, from the state."""

    names: list[str]
    table: list[np.ndarray]
    inner: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [*self.table, *self.inner, self.out, self.bias]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores (time, language, window) of byte windows (time, window)."""
        time, n = x.shape
        h = self.inner[0].shape[0]
        total = np.empty((time, len(self.names), n), np.float32)
        total[:] = self.bias.astype(np.float32)[None, :, None]
        gates, more, room = np.empty((3 * h, n), np.float32), np.empty((2 * h, n), np.float32), np.empty((3 * h, n), np.float32)
        for d in (0, 1):
            table = np.ascontiguousarray(self.table[d].T, np.float32)
            inner = np.ascontiguousarray(self.inner[d].T, np.float32)
            out = np.ascontiguousarray(self.out[d * h : (d + 1) * h].T, np.float32)
            state = np.zeros((h, n), np.float32)
            for t in range(time) if d == 0 else range(time - 1, -1, -1):
                np.take(table, x[t], axis=1, out=gates, mode="clip")
                np.matmul(inner[: 2 * h], state, out=more)
                zr, new = gates[: 2 * h], gates[2 * h :]
                zr += more
                squash(zr, room[: 2 * h])
                zr += 1
                zr *= 0.5
                np.multiply(zr[h:], state, out=room[:h])
                new += inner[2 * h :] @ room[:h]
                squash(new, room[:h])
                # state = z * state + (1 - z) * new
                state -= new
                state *= zr[:h]
                state += new
                total[t] += out @ state
        return total

    def label(self, texts: pa.Array, batch: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language or -1, its probability) of whole texts"""
        data, at = text_bytes(texts)
        n = len(at) - 1
        pooled, seen = np.zeros((n, len(self.names))), np.zeros(n, np.int64)
        sizes = np.diff(at)
        core = WIDTH - 2 * MARGIN
        count = -(-sizes // core)
        text = np.repeat(np.arange(n), count)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * core
        for a in range(0, len(text) if self.names else 0, batch):
            t, b = text[a : a + batch], begin[a : a + batch]
            inside = b[None, :] - MARGIN + np.arange(WIDTH)[:, None]
            ok = (inside >= 0) & (inside < sizes[t][None, :])
            window = np.where(ok, data[np.clip(at[t][None, :] + inside, 0, len(data) - 1)], 0)
            s = self.scores(window)
            ok[:MARGIN] = ok[WIDTH - MARGIN :] = False
            ok &= ~SPACE[window]
            s -= s.max(axis=1, keepdims=True)
            s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
            for k in range(len(self.names)):
                pooled[:, k] += np.bincount(t, np.where(ok, s[:, k], 0).sum(axis=0), minlength=n)
            seen += np.bincount(t, ok.sum(axis=0), minlength=n).astype(np.int64)
        if not self.names:
            return np.full(n, -1), np.zeros(n)
        # Neighbouring bytes say much the same, so the mean, and not the sum, is made a distribution.
        mean = pooled / np.maximum(seen, 1)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return np.where(seen > 0, p.argmax(axis=1), -1), np.where(seen > 0, p.max(axis=1), 0)


def _gru(x: np.ndarray, table: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, tuple]:
    time, n = x.shape
    h = inner.shape[0]
    s, g = np.zeros((time + 1, n, h)), np.empty((time, n, 3 * h))
    for t in range(time):
        e = table[x[t]]
        zr = 0.5 * (squash(e[:, : 2 * h] + s[t] @ inner[:, : 2 * h]) + 1)
        new = squash(e[:, 2 * h :] + (zr[:, h:] * s[t]) @ inner[:, 2 * h :])
        g[t, :, : 2 * h], g[t, :, 2 * h :] = zr, new
        s[t + 1] = zr[:, :h] * s[t] + (1 - zr[:, :h]) * new
    return s[1:], (x, inner, g, s)


def _gru_back(ds: np.ndarray, kept: tuple) -> tuple[np.ndarray, np.ndarray]:
    x, inner, g, s = kept
    time, n = x.shape
    h = inner.shape[0]
    d_inner, d_all = np.zeros_like(inner), np.empty((time, n, 3 * h))
    after = np.zeros((n, h))
    for t in range(time - 1, -1, -1):
        z, r, new = g[t, :, :h], g[t, :, h : 2 * h], g[t, :, 2 * h :]
        d = ds[t] + after
        pre = d_all[t]
        pre[:, 2 * h :] = d * (1 - z) * (1 - new * new) ** 1.5
        back = pre[:, 2 * h :] @ inner[:, 2 * h :].T
        pre[:, :h] = d * (s[t] - new) * 4 * (z * (1 - z)) ** 1.5
        pre[:, h : 2 * h] = back * s[t] * 4 * (r * (1 - r)) ** 1.5
        d_inner[:, : 2 * h] += s[t].T @ pre[:, : 2 * h]
        d_inner[:, 2 * h :] += (r * s[t]).T @ pre[:, 2 * h :]
        after = d * z + back * r + pre[:, : 2 * h] @ inner[:, : 2 * h].T
    one = np.zeros((256, x.size), np.float32)
    one[x.ravel(), np.arange(x.size)] = 1
    return one @ d_all.reshape(x.size, 3 * h), d_inner


def loss_and_gradients(m: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions of windows x (time, window) of languages y, and its gradients."""
    time, n = x.shape
    h = m.inner[0].shape[0]
    left, keep_left = _gru(x, m.table[0], m.inner[0])
    right, keep_right = _gru(x[::-1], m.table[1], m.inner[1])
    both = np.concatenate((left, right[::-1]), axis=2)
    s = both @ m.out + m.bias
    s -= s.max(axis=2, keepdims=True)
    s -= np.log(np.exp(s).sum(axis=2, keepdims=True))
    loss = -s[:, np.arange(n), y].mean()
    d = np.exp(s)
    d[:, np.arange(n), y] -= 1
    d /= time * n
    d_both = d @ m.out.T
    a0, b0 = _gru_back(d_both[:, :, :h], keep_left)
    a1, b1 = _gru_back(d_both[::-1, :, h:], keep_right)
    return float(loss), [a0, a1, b0, b1, both.reshape(-1, 2 * h).T @ d.reshape(-1, d.shape[2]), d.sum((0, 1))]


def new_network(names: list[str], hidden: int, seed: int) -> Network:
    r = np.random.default_rng(seed)
    return Network(names, [r.normal(0, 0.3, (256, 3 * hidden)) for _ in range(2)], [r.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden)) for _ in range(2)], r.normal(0, 0.3, (2 * hidden, len(names))), np.zeros(len(names)))


def train(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, rounds: int = ROUNDS, batch: int = 64, width: int = 64, seed: int = SEED) -> Network:
    """Adam over windows drawn from texts, languages alike. The same texts and seed give the same network."""
    names = sorted(set(labels))
    m = new_network(names, hidden, seed)
    if len(names) < 2:
        return m
    of = [[t for t, l in zip(texts, labels, strict=True) if l == name] for name in names]
    r = np.random.default_rng(seed)
    arrays = m.arrays()
    first, second = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]
    for step in range(1, rounds + 1):
        y = r.integers(0, len(names), batch)
        x = np.zeros((width, batch), np.uint8)
        for k in range(batch):
            t = of[y[k]][r.integers(0, len(of[y[k]]))]
            at = r.integers(0, max(1, len(t) - width + 1))
            piece = np.frombuffer(t[at : at + width], np.uint8)
            x[: len(piece), k] = piece
        _, grads = loss_and_gradients(m, x, y)
        scale = min(1.0, 1.0 / np.sqrt(sum(float((g * g).sum()) for g in grads)))
        rate = 0.02 * min(1.0, step / 20) * (0.5 * (1 + np.cos(np.pi * step / rounds)) + 0.01)
        for a, g, u, v in zip(arrays, grads, first, second, strict=True):
            g = g * scale
            u += 0.1 * (g - u)
            v += 0.01 * (g * g - v)
            a -= rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return m


def fit(docs: DataFrame, label: str = "lang", per_language: int = PER_LANGUAGE, windows: int = WINDOWS, **options) -> Network:
    got = common.training_windows(docs.select(F.col(label).alias("label"), "text"), per_language, windows, TRAINED)
    return train([w for _, w in got], [l for l, _ in got], width=TRAINED, **options)


def identify(docs: DataFrame, network: Network | None = None, label: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, language, confidence) of each document."""
    network = network or fit(docs, label, per_language)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        which, p = network.label(batch.column(1))
        return common.rows([common.longs(batch.column(0)), [network.names[k] if k >= 0 else "und" for k in which], np.round(p, 6)], SCHEMA)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    out = common.map_arrow(source, kernel, SCHEMA)
    return out.groupBy("doc_id").agg(F.max(F.struct("confidence", "language")).alias("best")).select("doc_id", F.col("best.language").alias("language"), F.col("best.confidence").alias("confidence"))
