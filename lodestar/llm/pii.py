"""Personal data (operator 9): a character-level bidirectional LSTM with a CRF, in numpy.

The model is trained here, by backpropagation through time and the CRF's forward-backward
algorithm, from labelled spans: words of the corpus without digits and at-signs (of passages at hashed places of
the `background` distinct texts with the least hashes, see common.training_windows), into which generated
e-mail addresses, phone and card numbers, IP addresses and secrets are put, beside numbers that are none of these.

Each whole text is cut into windows that overlap by `MARGIN` characters on either side. Viterbi
decodes each window. Of the windows that hold a character, the one with the character in its core
decides; so spans that cross windows are put together again. The model goes to the tasks (some 60 KB); the
pass over the documents is narrow.

Defined results
- Null and empty texts have no spans. Rows with a null doc_id can't be named by `spans`, but `redact` treats them alike.
- Neighbouring characters of one kind are one span; white space at its ends is left out.
- Repeated rows give the same spans; `spans` lists them once. Where two sequences of kinds score alike, the first kind counts.
- Very long texts are read whole, window by window. An empty table gives an empty result.
- Other columns, whatever their names, are ignored, and kept by `redact`, which sets n_chars where it is a number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import common

KINDS = ("O", "EMAIL", "PHONE", "CARD", "IP", "SECRET")
HIDDEN, WIDTH, MARGIN, SEED = 12, 320, 32, 7
BACKGROUND, PASSAGES, PASSAGE = 200, 10, 400  # texts, passages of each, bytes of a passage
SYMBOLS = 131  # 0 pads; 1 to 128: ASCII; 129: letters beyond; 130: others beyond
SPANS = pa.schema([("doc_id", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("kind", pa.string())])


def symbols(codes: np.ndarray) -> np.ndarray:
    """Numbers of characters given as code points."""
    out = np.where(codes < 128, codes + 1, 130)
    out[(codes >= 0xC0) & (codes < 0x250)] = 129
    return out.astype(np.uint8)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def squash(x: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """x / sqrt(1 + x**2), in place: the cells' sigmoid, a third of the time of tanh."""
    room = np.multiply(x, x, out=room)
    room += 1
    np.sqrt(room, out=room)
    x /= room
    return x


@dataclass
class Model:
    """table, inner: of each direction, from symbols and from the state to the gates i, f, o and g."""

    table: list[np.ndarray]
    inner: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [*self.table, *self.inner, self.out, self.bias, self.moves, self.first]

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (time, kind, window) of windows x (time, window), in arrays whose last axis is the windows."""
        time, n = x.shape
        h = self.inner[0].shape[0]
        total = np.empty((time, len(KINDS), n), np.float32)
        total[:] = self.bias.astype(np.float32)[None, :, None]
        gates, more, cell, act = np.empty((4 * h, n), np.float32), np.empty((4 * h, n), np.float32), np.empty((h, n), np.float32), np.empty((h, n), np.float32)
        for d in (0, 1):
            table = np.ascontiguousarray(self.table[d].T, np.float32)
            inner = np.ascontiguousarray(self.inner[d].T, np.float32)
            out = np.ascontiguousarray(self.out[d * h : (d + 1) * h].T, np.float32)
            state = np.zeros((h, n), np.float32)
            cell[:] = 0
            for t in range(time) if d == 0 else range(time - 1, -1, -1):
                np.take(table, x[t], axis=1, out=gates, mode="clip")
                np.matmul(inner, state, out=more)
                gates += more
                squash(gates, more)
                gates[: 3 * h] += 1
                gates[: 3 * h] *= 0.5
                cell *= gates[h : 2 * h]
                np.multiply(gates[:h], gates[3 * h :], out=act)
                cell += act
                act[:] = cell
                squash(act, more[:h])
                np.multiply(gates[2 * h : 3 * h], act, out=state)
                total[t] += out @ state
        return total

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Best kinds (time, window) for scores (time, kind, window).

        Windows in which every position's score for O leads by more than what transitions could ever
        win back are O throughout; the rest are decoded.
        """
        time, kinds, n = scores.shape
        best = np.zeros((time, n), np.uint8)
        reach = 2 * max(0.0, float(self.moves.max() - self.moves[0, 0]), float(self.first.max() - self.first[0]))
        lead = (scores[:, 0] - scores[:, 1:].max(axis=1)).min(axis=0)
        at = np.flatnonzero(lead <= reach)
        if not len(at):
            return best
        s = scores[:, :, at]
        back = np.empty((time, kinds, len(at)), np.uint8)
        now = s[0] + self.first[:, None]
        for t in range(1, time):
            step = now[:, None, :] + self.moves[:, :, None]
            back[t] = step.argmax(axis=0)
            now = step.max(axis=0) + s[t]
        k = now.argmax(axis=0)
        rows = np.arange(len(at))
        for t in range(time - 1, -1, -1):
            best[t, at] = k
            if t:
                k = back[t][k, rows]
        return best

    def decode(self, texts: list[str], batch: int = 2048) -> tuple[np.ndarray, ...]:
        """(text number, start, end, kind) of the spans of whole texts."""
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum():
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        codes = codes_of("".join(texts))
        x = symbols(codes)
        ends = np.cumsum(sizes)
        core = WIDTH - 2 * MARGIN
        count = -(-sizes // core)
        text = np.repeat(np.arange(len(texts)), count)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * core
        kinds = np.zeros(len(x), np.uint8)
        for a in range(0, len(text), batch):
            t, b = text[a : a + batch], begin[a : a + batch]
            inside = b[None, :] - MARGIN + np.arange(WIDTH)[:, None]
            ok = (inside >= 0) & (inside < sizes[t][None, :])
            place = (ends - sizes)[t][None, :] + inside
            window = np.where(ok, x[np.clip(place, 0, len(x) - 1)], 0)
            got = self.viterbi(self.emissions(window))
            ok[:MARGIN] = ok[WIDTH - MARGIN :] = False
            kinds[place[ok]] = got[ok]
        mark = np.repeat(np.arange(len(texts)), sizes)
        kinds[(codes == 32) & _edges(kinds, mark, codes)] = 0
        new = np.append(True, (kinds[1:] != kinds[:-1]) | (mark[1:] != mark[:-1]))
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(kinds))
        hit = kinds[start] > 0
        start, end = start[hit], end[hit]
        t = mark[start]
        return t, start - (ends - sizes)[t], end - (ends - sizes)[t], kinds[start].astype(np.int64)


def _edges(kinds: np.ndarray, mark: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Positions at the border of a span."""
    left = np.append(True, (kinds[1:] != kinds[:-1]) | (mark[1:] != mark[:-1]))
    return left | np.append(left[1:], True)


# --- training -----------------------------------------------------------------------------


def _word(r: np.random.Generator, letters: str, low: int, high: int) -> str:
    return "".join(r.choice(list(letters), r.integers(low, high)))


def _entity(r: np.random.Generator) -> tuple[str, str, str]:
    """(what stands before, the span, its kind)"""
    d = lambda n: "".join(str(x) for x in r.integers(0, 10, n))
    abc = "abcdefghijklmnopqrstuvwxyz"
    kind = KINDS[r.integers(1, len(KINDS))]
    if kind == "EMAIL":
        name = _word(r, abc, 2, 10 if r.random() < 0.7 else 25) + r.choice(["", ".", "_", "-"]) + r.choice([_word(r, abc, 1, 8), d(2), ""])
        name = name.strip("._-")
        if r.random() < 0.15:
            name = name.title()
        host = ".".join(_word(r, abc, 3, 9) + (d(1) if r.random() < 0.4 else "") for _ in range(r.integers(1, 3)))
        return "", f"{name}@{host}.{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io', 'co.uk'])}", kind
    if kind == "PHONE":
        a, b, c = d(3), d(3), d(4)
        return "", str(r.choice([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"{a}-{b}-{c}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"+1 {a} {b} {c}"])), kind
    if kind == "CARD":
        q = [str(r.integers(3, 7)) + d(3), d(4), d(4), d(4)]
        return "", r.choice(["", "", "", " ", "-"]).join(q), kind
    if kind == "IP":
        return "", ".".join(str(x) for x in r.integers(0, 256, 4)), kind
    if r.random() < 0.3:
        return "", "AKIA" + _word(r, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16, 17), kind
    value = _word(r, "0123456789abcdef", 16, 41) if r.random() < 0.7 else _word(r, abc + abc.upper() + "0123456789", 16, 41)
    key = r.choice(["token", "secret", "api_key", "password", "key", "access_token"])
    sign = r.choice(["=", " = ", ": "])
    if r.random() < 0.5:
        return f'{key}{sign}"', value, kind
    return f"{key}{sign}", value, kind


def _decoy(r: np.random.Generator) -> str:
    """Numbers and signs that aren't personal."""
    n = lambda a, b: str(r.integers(a, b))
    return str(
        r.choice(
            [
                n(1, 2030), f"{n(0, 10)}.{n(0, 10)}", f"Version {n(1, 9)}.{n(0, 9)}.", f"CC BY-NC {n(1, 5)}.0.", f"{n(1900, 2030)}-{n(10, 13)}-{n(10, 29)}", f"{n(0, 24)}:{n(10, 60)}", f"${n(1, 999)}.{n(10, 99)}",
                f"{n(1, 99)}%", f"{_word(r, 'aeiourst', 3, 9)}%%% {_word(r, 'aeiourst', 3, 9)}***", f"{n(1, 999)},{n(100, 999)}", f"({n(1, 99)})", f"[{n(1, 99)}]", f"v{n(1, 9)}.{n(0, 20)}.{n(0, 20)}", f"#{n(1, 9999)}", "@", "a @ b", "token", "password", "***", "&&&", "$$$ ###", "|", "key = value",
                f"item{n(1, 99)}", " ".join([_word(r, "abdeo", 1, 3) * int(r.integers(2, 4))] * int(r.integers(2, 9))), _word(r, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ", 4, 30), f"{_word(r, 'ABCDEFGH', 3, 9)}!! {_word(r, 'ABCDEFGH', 3, 9)}!!", f"http://{_word(r, 'abcdefgh', 3, 8)}.com/{n(1, 99)}", "=", '"', "''", f"{n(100000, 999999)}",
            ]
        )
    )


def examples(background: list[str], count: int, width: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, kinds), each (width, count): windows of background with spans put in."""
    r = np.random.default_rng(seed)
    words = [w for t in background for w in t.split() if not any(c.isdigit() or c == "@" for c in w)] or ["word", "text", "other"]
    x, y = np.zeros((width, count), np.uint8), np.zeros((width, count), np.uint8)
    for k in range(count):
        parts: list[tuple[str, int]] = []
        size = 0
        while size < width + 30:
            u = r.random()
            if u < 0.1:
                before, span, kind = _entity(r)
                if r.random() < 0.15:  # neighbours
                    b, other, also = _entity(r)
                    parts += [(b, 0), (other, KINDS.index(also)), ('"' if b.endswith('"') else "", 0), (" ", 0)]
                pair = [(before, 0), (span, KINDS.index(kind)), ('"' if before.endswith('"') else str(r.choice(["", "", ".", ",", ";", ")"])), 0)]
            elif u < 0.16:
                pair = [(_decoy(r), 0)]
            else:
                at = r.integers(0, len(words))
                pair = [(" ".join(words[at : at + r.integers(1, 6)]), 0)]
            parts += [*pair, (str(r.choice([" ", " ", " ", " ", "\n"])), 0)]
            size = sum(len(p) for p, _ in parts)
        text, kinds = "".join(p for p, _ in parts), np.concatenate([np.full(len(p), k_, np.uint8) for p, k_ in parts])
        skip = r.integers(0, 30)  # windows also begin inside of spans
        x[:, k], y[:, k] = symbols(codes_of(text)[skip : skip + width]), kinds[skip : skip + width]
        if r.random() < 0.2:
            cut = r.integers(0, width // 2)
            x[:cut, k], y[:cut, k] = 0, 0
    return x, y


def _new(hidden: int, seed: int) -> Model:
    r = np.random.default_rng(seed)
    k = len(KINDS)
    table = [r.normal(0, 0.3, (SYMBOLS, 4 * hidden)) for _ in range(2)]
    for t in table:
        t[:, hidden : 2 * hidden] += 0.5  # gates forget little at first
    return Model(table, [r.normal(0, 0.5 / np.sqrt(hidden), (hidden, 4 * hidden)) for _ in range(2)], r.normal(0, 0.3, (2 * hidden, k)), np.zeros(k), np.zeros((k, k)), np.zeros(k))


def _lstm(x: np.ndarray, table: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, tuple]:
    time, n = x.shape
    h = inner.shape[0]
    g, c, s = np.empty((time, n, 4 * h)), np.zeros((time + 1, n, h)), np.zeros((time + 1, n, h))
    for t in range(time):
        a = squash(table[x[t]] + s[t] @ inner)
        a[:, : 3 * h] = 0.5 * (a[:, : 3 * h] + 1)
        g[t] = a
        c[t + 1] = a[:, h : 2 * h] * c[t] + a[:, :h] * a[:, 3 * h :]
        s[t + 1] = a[:, 2 * h : 3 * h] * squash(c[t + 1].copy())
    return s[1:], (x, inner, g, c, s)


def _lstm_back(ds: np.ndarray, kept: tuple) -> tuple[np.ndarray, np.ndarray]:
    x, inner, g, c, s = kept
    time, n = x.shape
    h = inner.shape[0]
    d_table, d_inner = np.zeros((SYMBOLS, 4 * h)), np.zeros_like(inner)
    d_all = np.empty((time, n, 4 * h))
    next_s, next_c = np.zeros((n, h)), np.zeros((n, h))
    for t in range(time - 1, -1, -1):
        a = g[t]
        i, f, o, z = a[:, :h], a[:, h : 2 * h], a[:, 2 * h : 3 * h], a[:, 3 * h :]
        tc = squash(c[t + 1].copy())
        d = ds[t] + next_s
        dc = next_c + d * o * (1 - tc * tc) ** 1.5
        pre = d_all[t]
        # The derivative of squash is (1 - z**2)**1.5, and that of a gate p = (1 + z) / 2 is 4 (p (1 - p))**1.5.
        pre[:, :h] = dc * z * 4 * (i * (1 - i)) ** 1.5
        pre[:, h : 2 * h] = dc * c[t] * 4 * (f * (1 - f)) ** 1.5
        pre[:, 2 * h : 3 * h] = d * tc * 4 * (o * (1 - o)) ** 1.5
        pre[:, 3 * h :] = dc * i * (1 - z * z) ** 1.5
        next_c = dc * f
        next_s = pre @ inner.T
        d_inner += s[t].T @ pre
    flat = x.ravel()
    one = np.zeros((SYMBOLS, len(flat)), np.float32)
    one[flat, np.arange(len(flat))] = 1
    d_table += one @ d_all.reshape(len(flat), 4 * h)
    return d_table, d_inner


def loss_and_gradients(m: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of kinds y (time, window) under the CRF, and its gradients in the order of arrays()."""
    time, n = x.shape
    h = m.inner[0].shape[0]
    left, keep_left = _lstm(x, m.table[0], m.inner[0])
    right, keep_right = _lstm(x[::-1], m.table[1], m.inner[1])
    both = np.concatenate((left, right[::-1]), axis=2)
    e = both @ m.out + m.bias
    k = len(KINDS)
    # Forward and backward sums in logarithms.
    alpha, beta = np.empty((time, n, k)), np.zeros((time, n, k))
    total = lambda a, axis: (top := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - top).sum(axis=axis))
    alpha[0] = e[0] + m.first
    for t in range(1, time):
        alpha[t] = total(alpha[t - 1][:, :, None] + m.moves, 1) + e[t]
    for t in range(time - 2, -1, -1):
        beta[t] = total(m.moves[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = total(alpha[-1], 1)
    rows = np.arange(n)
    gold = e[np.arange(time)[:, None], rows, y].sum(0) + m.first[y[0]] + m.moves[y[:-1], y[1:]].sum(0)
    de = np.exp(alpha + beta - z[:, None])
    d_first = de[0].sum(0) - np.bincount(y[0], minlength=k)
    pair = np.exp(alpha[:-1, :, :, None] + m.moves + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None]).sum((0, 1))
    d_moves = pair - np.bincount(y[:-1].ravel().astype(np.int64) * k + y[1:].ravel(), minlength=k * k).reshape(k, k)
    de[np.arange(time)[:, None], rows, y] -= 1
    d_out = both.reshape(-1, 2 * h).T @ de.reshape(-1, k)
    d_both = de @ m.out.T
    a0, b0 = _lstm_back(d_both[:, :, :h], keep_left)
    a1, b1 = _lstm_back(d_both[::-1, :, h:], keep_right)
    grads = [a0, a1, b0, b1, d_out, de.sum((0, 1)), d_moves, d_first]
    return float((z - gold).mean()), [g / n for g in grads]


def train(background: list[str], hidden: int = HIDDEN, rounds: int = 400, batch: int = 48, width: int = 96, seed: int = SEED) -> Model:
    """Adam over windows of examples(); the same texts and seed give the same model."""
    x, y = examples(background, batch * 60, width, seed)
    m = _new(hidden, seed)
    arrays = m.arrays()
    first, second = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]
    r = np.random.default_rng(seed)
    for step in range(1, rounds + 1):
        at = r.integers(0, x.shape[1], batch)
        _, grads = loss_and_gradients(m, x[:, at], y[:, at])
        scale = min(1.0, 5.0 / np.sqrt(sum(float((g * g).sum()) for g in grads)))
        rate = 0.02 * min(1.0, step / 20) * (0.5 * (1 + np.cos(np.pi * step / rounds)) + 0.01)
        for a, g, u, v in zip(arrays, grads, first, second, strict=True):
            g = g * scale
            u += 0.1 * (g - u)
            v += 0.01 * (g * g - v)
            a -= rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return m


# --- Spark --------------------------------------------------------------------------------


def fit(docs: DataFrame, background: int = BACKGROUND, **options) -> Model:
    """The model for docs; their texts are but the background that labelled spans are put into."""
    got = common.training_windows(docs.select(F.lit("").alias("label"), "text"), background, PASSAGES, PASSAGE)
    # A window's first and last word may be cut.
    return train([" ".join(w.decode("utf-8", "ignore").split()[1:-1]) for _, w in got], **options)


def spans(docs: DataFrame, model: Model | None = None, background: int = BACKGROUND) -> DataFrame:
    """(doc_id, start_char, end_char, kind): characters count from 0, end_char is exclusive."""
    model = model or fit(docs, background)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, start, end, kind = model.decode(pc.fill_null(batch.column(1), "").to_pylist())
        return common.rows([common.longs(batch.column(0))[text], start, end, [KINDS[k] for k in kind]], SPANS)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return common.map_arrow(source, kernel, SPANS, most=4 << 20).distinct()


def redact(docs: DataFrame, model: Model | None = None, background: int = BACKGROUND) -> DataFrame:
    """docs, with all columns and rows; each span of a text is replaced by its kind in brackets, as [EMAIL]."""
    model = model or fit(docs, background)
    at = docs.columns.index("text")
    count = next((k for k, f in enumerate(docs.schema) if f.name == "n_chars" and f.dataType.typeName() in ("long", "integer", "short")), None)

    def run(batches):
        for batch in common.pieces(batches, at, 4 << 20):
            texts = pc.fill_null(batch.column(at), "").to_pylist()
            parts: dict[int, list] = {}
            for t, a, b, k in zip(*(v.tolist() for v in model.decode(texts)), strict=True):
                parts.setdefault(t, []).append((a, b, k))
            changed = batch.column(at).to_pylist()
            for t, found in parts.items():
                out, done = [], 0
                for a, b, k in found:
                    out += [texts[t][done:a], f"[{KINDS[k]}]"]
                    done = b
                changed[t] = "".join([*out, texts[t][done:]])
            columns = list(batch.columns)
            columns[at] = pa.array(changed, batch.schema.field(at).type)
            if count is not None:
                sizes = columns[count].to_pylist()
                for t in parts:
                    sizes[t] = len(changed[t])
                columns[count] = pa.array(sizes, batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
