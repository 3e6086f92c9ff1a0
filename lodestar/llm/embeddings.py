"""Embedding near-dedup (operator 3) by cells around pivots, and navigable small-world graphs in cells that are too large to compare.

1. Pivots are fitted on a bounded sample: of each length of vectors, the rows with the least hashes of their vec_id, as many as
   the square root of 4.5 times the table asks for (at most one for `shard_rows` rows) and 1,024 to audit. Pivots
   are taken densest first, and none near another, so that a crowd of near vectors has one pivot, not many.
2. Every vector is put into the cell of its most similar pivot, and into those of all pivots whose similarity is less by no
   more than `slack`. Two vectors are compared where they share a cell. The slack comes from an audit: of pairs of a
   sampled vector and a probe (that vector, turned until its cosine is just the threshold), and of near pairs of sampled
   vectors, a share of `recall` have to meet in a cell. Pairs beyond the threshold meet more often. Similarities are taken as they are or from
   the mean of the sample, which parts vectors that all lean one way. Of these and some spacings and numbers of pivots
   the one with the least work is taken, in comparisons and copies, among those that need no more than `COPIES` copies of a vector on average; where none does, one cell has all.
3. A cell is compared in full. For groups its crowds are found first: vectors within half the angle of the threshold of
   one vector are near each other, so they are linked without comparing them, and of the others only those within 1.5 times the angle
   of that vector are compared with them. That loses no link between groups.
4. What is left of a cell beyond `graph_rows` is searched by a hierarchical navigable small-world graph: the level of a vector
   is geometric; every vector is linked to its `links` nearest on its levels, found by beam searches in the graph so far,
   and links that a nearer neighbour makes needless are dropped. A beam is widened as long as it is full of vectors that
   reach the threshold. `audit` queries and as many probes are also answered by brute force; while the beams find less than
   `recall` of these pairs they are doubled; beyond `WIDEST` the cell is scanned. Below that size numpy compares a cell sooner than it builds a graph.
5. Pairs at the threshold have their cosine computed anew in double precision; components of the pairs are united. For that,
   `groups` takes from each cell a forest that links the same vectors, not all of its pairs. Its cells have unit vectors rounded to 16 bits a number;
   pairs that are as close to the threshold as rounding errs are decided by the vectors themselves, read again.

With n vectors, comparisons grow as n to the power 1.5; what is shuffled is each vector and its copies, in proportion to n. A cell is
in the memory of one task.

Defined results
- Vectors that are null, empty, zero, not finite or hold nulls have no neighbours; nor have rows with a null vec_id.
- Vectors of different lengths aren't compared. Equal vectors have cosine 1.
- Repeated rows (one vec_id) are one vector; of different vectors the first by order counts. An empty table gives an empty result.
- Ties don't matter: a pair at the threshold counts, and a group is named by its least vec_id.
- Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import common
from lodestar.llm.text import mix

THRESHOLD, SHARD_ROWS, LINKS, BEAM, RECALL, AUDIT, WIDEST = 0.95, 1_000, 12, 24, 0.97, 64, 256
CHECKS, COPIES, COPY, CROWD, GRAPH_ROWS, ROUND = 1_024, 16, 4_000, 2_048, 1_000_000, 32_767  # COPY: comparisons that cost as much as to send a copy
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64())])


def _level(ids: np.ndarray, links: int) -> np.ndarray:
    u = (mix(ids.astype(np.uint64) + np.uint64(17)) >> np.uint64(11)).astype(float) / (1 << 53)
    return np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(links)).astype(int)


class Graph:
    """vectors: unit rows; links: for each level, rows of neighbours (-1 where there are fewer)."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: int):
        n = len(vectors)
        self.vectors, self.width = vectors, links
        order = np.argsort(-levels, kind="stable")  # high levels first, so that lower ones can descend
        self.levels = [np.full((n, 2 * links if l == 0 else links), -1, np.int32) for l in range(int(levels.max(initial=0)) + 1)]
        self.entry = int(order[0]) if n else -1
        done = 1
        while done < n:
            new = order[done : done + max(1, min(done, 2048))]
            self._insert(new, levels, order[:done])
            done += len(new)

    def _insert(self, new: np.ndarray, levels: np.ndarray, old: np.ndarray) -> None:
        near = np.full(len(new), self.entry)
        for level in range(len(self.levels) - 1, -1, -1):
            here = np.flatnonzero(levels[new] >= level)
            if len(here) < len(new):
                rest = np.flatnonzero(levels[new] < level)
                near[rest] = self.search_level(self.vectors[new[rest]], near[rest], level, 1)[0][:, 0]
            if not len(here):
                continue
            q = new[here]
            beam = max(2 * self.width, 16)
            found, sims = self.search_level(self.vectors[q], near[here], level, beam)
            # Those of the batch see each other too.
            k = min(len(q), self.width + 1)
            for a in range(0, len(q), 512):
                s = self.vectors[q[a : a + 512]] @ self.vectors[q].T
                s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                f = np.hstack((found[a : a + 512], q[top]))
                v = np.hstack((sims[a : a + 512], np.take_along_axis(s, top, 1)))
                v[f == q[a : a + 512, None]] = -2
                self._link(q[a : a + 512], f, v, level)
            near[here] = found[:, 0]

    def _link(self, q: np.ndarray, found: np.ndarray, sims: np.ndarray, level: int) -> None:
        out = self._pick(q, found, sims, self.width)
        table = self.levels[level]
        room = table.shape[1]
        table[q, : out.shape[1]] = out
        src, dst = np.repeat(q, out.shape[1]), out.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        for k in np.argsort(dst, kind="stable"):  # links back; a full row keeps its best
            row = table[dst[k]]
            if src[k] in row:
                continue
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = src[k]
            else:
                s = self.vectors[np.append(row, src[k])] @ self.vectors[dst[k]]
                picked = self._pick(dst[k : k + 1], np.append(row, src[k])[None, :], s[None, :], room)[0]
                row[:] = -1
                row[: len(picked)] = picked

    def _pick(self, q: np.ndarray, found: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates those that no nearer pick is closer to than q is, then the nearest others."""
        by = np.argsort(-sims, axis=1, kind="stable")
        found, sims = np.take_along_axis(found, by, 1), np.take_along_axis(sims, by, 1)
        ok = (found >= 0) & (sims > -1.5)
        ok[:, 1:] &= found[:, 1:] != found[:, :-1]
        v = self.vectors[np.maximum(found, 0)]
        between = v @ v.transpose(0, 2, 1)
        keep = np.zeros_like(ok)
        for c in range(found.shape[1]):
            blocked = (keep & (between[:, c, :] > sims[:, c : c + 1])).any(axis=1)
            keep[:, c] = ok[:, c] & ~blocked & (keep.sum(axis=1) < most)
        rank = np.where(keep, 0, np.where(ok, 1, 2))
        by = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(rank, by, 1) < 2, np.take_along_axis(found, by, 1), -1)

    def search_level(self, q: np.ndarray, start: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(neighbours, similarities) of each row of q, best first, by a beam over one level; all rows step at once."""
        n, m = len(self.vectors), len(q)
        table = self.levels[level]
        ids, sims = np.full((m, beam), -1, np.int32), np.full((m, beam), -2, np.float32)
        opened = np.ones((m, beam), bool)
        seen = np.zeros((m, n), bool)
        rows = np.arange(m)
        ids[:, 0], sims[:, 0], opened[:, 0] = start, np.einsum("ij,ij->i", q, self.vectors[start]), False
        seen[rows, start] = True
        live = rows
        while len(live):
            todo = np.where(opened[live], -3, sims[live])
            pick = todo.argmax(axis=1)
            more = todo[np.arange(len(live)), pick] > -2
            live, pick = live[more], pick[more]
            if not len(live):
                break
            opened[live, pick] = True
            near = table[ids[live, pick]]
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(near >= 0)
            seen[live[r], near[r, c]] = True
            s = np.einsum("ijk,ik->ij", self.vectors[np.maximum(near, 0)], q[live])
            s = np.where(fresh, s, -2)
            all_s = np.hstack((sims[live], s))
            by = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            sims[live] = np.take_along_axis(all_s, by, 1)
            ids[live] = np.take_along_axis(np.hstack((ids[live], np.where(fresh, near, -1))), by, 1)
            opened[live] = np.take_along_axis(np.hstack((opened[live], ~fresh)), by, 1)
        return ids, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        near = np.full(len(q), self.entry)
        for level in range(len(self.levels) - 1, 0, -1):
            near = self.search_level(q, near, level, 1)[0][:, 0]
        return self.search_level(q, near, 0, min(beam, len(self.vectors)))

    def within(self, q: np.ndarray, threshold: float, beam: int, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(row of q, vector) for what the beams find at the threshold; full beams are widened, and beyond WIDEST
        the shard is scanned, which then is cheaper."""
        left, right = [], []
        for a in range(0, len(q), rows):
            todo, b = np.arange(a, min(a + rows, len(q))), beam
            while len(todo):
                if b > WIDEST:
                    r, c = np.nonzero(q[todo] @ self.vectors.T >= threshold)
                    left.append(todo[r])
                    right.append(c.astype(np.int64))
                    break
                ids, sims = self.search(q[todo], b)
                full = (sims[:, -1] >= threshold) & (ids.shape[1] < len(self.vectors))
                r, c = np.nonzero((sims >= threshold) & ~full[:, None])
                left.append(todo[r])
                right.append(ids[r, c].astype(np.int64))
                todo, b = todo[full], 4 * b
        return np.concatenate(left) if left else np.zeros(0, np.int64), np.concatenate(right) if right else np.zeros(0, np.int64)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def probes(vectors: np.ndarray, ids: np.ndarray, threshold: float, audit: int) -> np.ndarray:
    """Vectors whose cosine with one of `audit` vectors is just the threshold, each in another direction."""
    chosen = np.argsort(mix(ids.astype(np.uint64) + np.uint64(3)), kind="stable")[:audit]
    v = vectors[chosen].astype(np.float64)
    noise = np.random.default_rng(len(ids)).normal(size=v.shape)
    noise -= (noise * v).sum(axis=1, keepdims=True) * v
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    t = min(1.0, threshold + 1e-4)
    return (t * v + np.sqrt(max(0.0, 1 - t * t)) * noise).astype(np.float32)


def audited(graph: Graph, ids: np.ndarray, q_ids: np.ndarray, q: np.ndarray, threshold: float, beam: int, recall: float, audit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, vectors, beam): pairs at the threshold, with the beam that passed the audit."""
    chosen = np.argsort(mix(q_ids.astype(np.uint64)), kind="stable")[:audit]
    sample = np.concatenate((q[chosen], probes(graph.vectors, ids, threshold, audit)))
    truth = sample @ graph.vectors.T >= threshold
    truth[: len(chosen)] &= ids[None, :] != q_ids[chosen, None]
    need = int(truth.sum())
    while True:
        r, c = graph.within(sample, threshold, beam)
        hit = int(truth[r, c].sum())
        if hit >= recall * need or beam >= len(graph.vectors):
            break
        beam *= 2
    r, c = graph.within(q, threshold, beam)
    return r, c, beam


class Index(NamedTuple):
    centre: np.ndarray
    pivots: np.ndarray  # unit rows, seen from the centre
    slack: float


def _pivots(pool: np.ndarray, near: float, most: int) -> np.ndarray:
    """Up to `most` rows of pool, in order, none of which has a cosine of `near` or more with one before it."""
    picked = pool[:0]
    for k in range(0, len(pool), 512):
        block = pool[k : k + 512]
        if len(picked):
            block = block[(block @ picked.T).max(axis=1) < near]
        s, keep = block @ block.T, np.ones(len(block), bool)
        for i in range(len(block)):
            if keep[i]:
                keep[i + 1 :] &= s[i, i + 1 :] < near
        picked = np.concatenate((picked, block[keep]))[:most]
        if len(picked) == most:
            break
    return picked


def _turned(u: np.ndarray, centre: np.ndarray) -> np.ndarray:
    v = u - centre
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _gaps(u: np.ndarray, index: Index) -> np.ndarray:
    """By how much each pivot is less similar to a row, both seen from the centre, than the row's most similar pivot."""
    s = _turned(u, index.centre) @ index.pivots.T
    return s.max(axis=1, keepdims=True) - s


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.nonzero, which takes longer for a matrix than for one row where little is true."""
    return np.divmod(np.flatnonzero(mask.ravel()), mask.shape[1])


def _cells(u: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(row, pivot) where the gap is at most the slack."""
    s = _turned(u, index.centre) @ index.pivots.T
    return _where(s >= s.max(axis=1, keepdims=True) - np.float32(index.slack))


def wanted(n: int, shard_rows: int) -> int:
    """The pivots of n vectors: about as many comparisons with pivots as in cells, and no cells of few rows."""
    return max(1, int(min(n / shard_rows, np.sqrt(4.5 * n))))


def fit(sample: np.ndarray, n: int, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, recall: float = RECALL, copy: float = COPY) -> Index:
    """The index of n vectors, from a sample of them in an order by hash."""
    want = wanted(n, shard_rows)
    nowhere = np.zeros(sample.shape[1], np.float32)
    one = Index(nowhere, sample[:1], 2.0)
    if want < 2 or len(sample) < 4:
        return one
    checks = min(CHECKS, len(sample) // 2)
    held, pool = sample[:checks], sample[checks:]
    probed = probes(held, np.arange(checks), threshold, checks)
    order = np.argsort(mix(np.arange(checks).astype(np.uint64) + np.uint64(3)), kind="stable")  # that of the probes
    density = np.concatenate([(pool[k : k + 256] @ pool.T >= threshold).sum(axis=1) for k in range(0, len(pool), 256)])
    pool_by = pool[np.argsort(-density, kind="stable")]
    r, c = np.nonzero(held @ pool.T >= threshold)
    step = -(-len(r) // 4096) or 1
    pairs = [(held[order], probed), (held[r[::step]], pool[c[::step]])]
    best, least = one, float(n) * n / 2 + copy * n
    for loose in (4, 2, 1):
        for most in dict.fromkeys((want, max(2, want // 4), max(2, want // 16))):
            pivots = _pivots(pool_by, 1 - loose * (1 - threshold), most)
            if len(pivots) < 2:
                continue
            for centre in (nowhere, sample.mean(axis=0)):
                index, slack = Index(centre, _turned(pivots, centre), 0.0), 0.0
                for x, y in pairs:
                    if len(x):
                        meets = np.concatenate([np.maximum(_gaps(x[k : k + 256], index), _gaps(y[k : k + 256], index)).min(axis=1) for k in range(0, len(x), 256)])
                        slack = max(slack, float(np.quantile(meets, recall, method="higher")))
                index, size = index._replace(slack=slack + 1e-5), np.zeros(len(pivots))
                for k in range(0, checks, 256):
                    size += (_gaps(held[k : k + 256], index) <= index.slack).sum(axis=0)
                work = float((size * (size - 1)).sum()) / 2 * (n / checks) ** 2 + float(n) * len(pivots)
                work += copy * n * size.sum() / checks
                if size.sum() <= COPIES * checks and work < least:
                    best, least = index, work
    return best


def margin(dim: int) -> float:
    """By how much the cosine of two vectors can change as their unit rows are rounded to 16 bits a number."""
    return 1.01 * float(np.sqrt(dim)) / ROUND


def _listed(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim)


def _verified(raw: np.ndarray, r: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cos = np.concatenate([np.einsum("ij,ij->i", _unit(raw[r[k : k + 65536]]), _unit(raw[c[k : k + 65536]])) for k in range(0, len(r), 65536)]) if len(r) else np.zeros(0)
    ok = cos >= threshold - 1e-12
    return r[ok], c[ok], np.minimum(cos[ok], 1)


def _near(u: np.ndarray, v: np.ndarray, low: float, same: bool = False):
    """(row of u, row of v, cosine) with cosines from low, some at a time; same: u is v, and each pair comes once."""
    rows = max(1, min(512, (1 << 23) // max(1, len(v))))
    for k in range(0, len(u), rows):
        at = k if same else 0
        s = u[k : k + rows] @ v[at:].T
        r, c = _where(s >= low)
        if same:
            r, c = r[c > r], c[c > r]
        yield r + k, c + at, s[r, c]


def _compared(u: np.ndarray, ids: np.ndarray, low: float, graph_rows: int, links: int, beam: int, recall: float, audit: int):
    """(row, row, cosine) of the near pairs of u."""
    if len(u) <= graph_rows:
        yield from _near(u, u, low, same=True)
        return
    r, c, _ = audited(Graph(u, _level(ids, links), links), ids, ids, u, low, beam, recall, audit)
    r, c = np.minimum(r, c)[r != c], np.maximum(r, c)[r != c]
    for k in range(0, len(r), 65536):
        yield r[k : k + 65536], c[k : k + 65536], np.einsum("ij,ij->i", u[r[k : k + 65536]], u[c[k : k + 65536]])


def forest(raw: np.ndarray, ids: np.ndarray, threshold: float, margin: float = 0, graph_rows: int = GRAPH_ROWS, links: int = LINKS, beam: int = BEAM, recall: float = RECALL, audit: int = AUDIT, crowd: int = CROWD) -> tuple[np.ndarray, ...]:
    """(root, row, left, right): the rows of a cell that aren't roots, and the components of its near pairs; with a margin, by
    which cosines of rounded vectors err at most, pairs between components that the vectors themselves have to decide."""
    n, u = len(raw), _unit(raw).astype(np.float32) if not margin else raw
    angle, err = np.arccos(threshold), margin + 1e-5
    low, sure, half, far = threshold - err, threshold + err, np.cos(angle / 2) + err, np.cos(min(np.pi, 1.5 * angle)) - err
    root = np.arange(n)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(r: np.ndarray, c: np.ndarray, most: int = 1 << 20) -> None:
        nonlocal root
        held.append((r, c))
        if sum(len(x) for x, _ in held) >= most:
            a, b = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            root = common.roots(n, np.concatenate((root, a)), np.concatenate((np.arange(n), b)))
            held.clear()

    unsure: list[tuple[np.ndarray, np.ndarray]] = [(root[:0], root[:0])]

    def decide(r: np.ndarray, c: np.ndarray, s: np.ndarray) -> None:
        ok = s >= sure
        add(r[ok], c[ok])
        if margin:
            unsure.append((r[~ok], c[~ok]))
        else:
            add(*_verified(raw, r[~ok], c[~ok], threshold)[:2])

    rest, balls = np.arange(n), []
    while len(rest) > crowd:
        lead = rest[:: -(-len(rest) // 64)]
        near = u[lead] @ u[rest].T >= half
        k = int(near.sum(axis=1).argmax())
        if near[k].sum() < max(64, len(rest) // 16):
            break
        balls.append((lead[k], rest[near[k]]))
        rest = rest[~near[k]]
    for r, c, s in _compared(u[rest], ids[rest], low, graph_rows, links, beam, recall, audit):
        decide(rest[r], rest[c], s)
    for lead, ball in balls:
        s, out = u @ u[lead], np.ones(n, bool)
        out[ball] = False
        linked = np.concatenate((ball, np.flatnonzero(out & (s >= sure))))
        add(np.full(len(linked), lead), linked)
        ring = np.flatnonzero(out & (s < sure) & (s >= far))
        for r, c, s in _near(u[ring], u[ball], low):
            decide(ring[r], ball[c], s)
    add(root[:0], root[:0], 0)
    rows = np.flatnonzero(root != np.arange(n))
    left, right = (np.concatenate([x[k] for x in unsure]) for k in (0, 1))
    apart = root[left] != root[right]
    return root[rows], rows, left[apart], right[apart]


def _searched(vectors: DataFrame, united: bool, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, recall: float = RECALL, **search) -> DataFrame:
    """(a, b, cosine) of the pairs that each cell has; united: of each vector in a pair and the least one that the cell's pairs lead to,
    and of pairs that rounding leaves open.

    search: options of `forest` for cells that need a graph."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: F.coalesce(x != 0, F.lit(False)))
    # The sample: by hash, and as many vectors of each length as fit() can use.
    place = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 40))
    counts = {r["dim"]: r["n"] for r in v.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect() if r["dim"] and wanted(r["n"], shard_rows) > 1}
    index: dict[int, Index] = {}
    if counts:
        take = [(dim, int(min(1, (CHECKS + max(2048, 1.25 * wanted(n, shard_rows))) / n) * (1 << 40))) for dim, n in counts.items()]
        take = vectors.sparkSession.createDataFrame(take, "dim int, most long")
        drawn = v.withColumn("dim", F.size("v")).join(F.broadcast(take), "dim").where((place < F.col("most")) & fine)
        drawn = drawn.groupBy("id").agg(F.min("v").alias("v")).select("id", place.alias("h"), F.size("v").alias("dim"), "v").toArrow().sort_by([("dim", "ascending"), ("h", "ascending"), ("id", "ascending")])
        sizes = drawn.column("dim").to_numpy()
        for dim, n in counts.items():
            own = drawn.filter(pa.array(sizes == dim)).column("v").combine_chunks()
            if len(own):
                sample = own.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                index[dim] = fit(_unit(sample).astype(np.float32), n, threshold, shard_rows, recall)
    index = {dim: x for dim, x in index.items() if len(x.pivots) > 1}

    # For groups, copies are sent as 16 bits a number; what that leaves open is decided by the vectors themselves.
    def route(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes[sizes > 0]):
                own = batch.filter(pa.array(sizes == dim))
                dim = int(dim)
                raw = _listed(own.column(1), dim)
                good = np.isfinite(raw).all(axis=1) & (raw != 0).any(axis=1)
                raw, ids = raw[good], own.column(0).to_numpy()[good]
                n, q = len(ids), _unit(raw)
                each, cells = np.ones(n, np.int64), np.zeros(n, np.int32)
                if dim in index and n:
                    rows = max(1, min(1024, (1 << 23) // len(index[dim].pivots)))
                    found = [_cells(q[k : k + rows].astype(np.float32), index[dim]) for k in range(0, n, rows)]
                    each = np.concatenate([np.bincount(r, minlength=min(rows, n - k * rows)) for k, (r, _) in enumerate(found)])
                    cells = np.concatenate([c for _, c in found]).astype(np.int32)
                data = np.round(q * ROUND).astype(np.int16) if united else np.ascontiguousarray(raw)
                width = data.itemsize * dim
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(data)])
                listed = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(each))).astype(np.int32), pa.array(cells))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(n, dim, np.int32)), packed, listed], names=["id", "dim", "v", "cells"])

    def search_cell(table: pa.Table) -> pa.Table:
        dim, ids = table.column("dim")[0].as_py(), table.column("id").to_numpy()
        packed = table.column("v").cast(pa.large_binary()).combine_chunks()
        at = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
        raw = np.frombuffer(packed.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.int16 if united else np.float32).reshape(-1, dim)
        by = np.argsort(ids, kind="stable")
        ids, raw = ids[by], raw[by]
        if united:
            a, b, c, d = forest(raw.astype(np.float32) / np.float32(ROUND), ids, threshold, margin(dim), recall=recall, **search)
            left, right = np.concatenate((ids[a], ids[c])), np.concatenate((ids[b], ids[d]))
            return pa.Table.from_batches([common.rows([left, right, np.repeat([1.0, 0.0], (len(a), len(c)))], PAIRS)])
        options = {"graph_rows": GRAPH_ROWS, "links": LINKS, "beam": BEAM, "audit": AUDIT} | search
        found = [_verified(raw, r, c, threshold) for r, c, _ in _compared(_unit(raw).astype(np.float32), ids, threshold - 1e-5, recall=recall, **options)]
        return pa.Table.from_batches([common.rows([ids[r], ids[c], np.round(cos, 9)], PAIRS) for r, c, cos in found], PAIRS)

    if v.groupBy("id").count().where("count > 1").limit(1).count():
        v = v.where(fine).groupBy("id").agg(F.min("v").alias("v"))
    copies = v.mapInArrow(route, "id long, dim int, v binary, cells array<int>").select("id", "dim", "v", F.explode("cells").alias("cell"))
    found = copies.groupBy("dim", "cell").applyInArrow(lambda t: search_cell(t), "a long, b long, cosine double")
    if not united:
        return found
    found = common.cut(found)
    unsure = found.where("cosine = 0").select("a", "b").distinct()
    ends = common.cut(unsure.select(F.col("a").alias("id")).unionByName(unsure.select(F.col("b").alias("id"))).distinct())
    few = ends.count()
    if not few:
        return found
    own = common.cut(v.join(F.broadcast(ends) if few <= 500_000 else ends, "id"))

    def check(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                same = batch.filter(pa.array(sizes == dim))
                x, y = _unit(_listed(same.column(1), int(dim))), _unit(_listed(same.column(3), int(dim)))
                ok = np.einsum("ij,ij->i", x, y) >= threshold - 1e-12
                yield common.rows([same.column(0).to_numpy()[ok], same.column(2).to_numpy()[ok], np.ones(int(ok.sum()))], PAIRS)

    both = unsure.join(own.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(own.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    return found.where("cosine > 0").unionByName(both.select("a", "va", "b", "vb").mapInArrow(check, "a long, b long, cosine double"))


def near_pairs(vectors: DataFrame, **options) -> DataFrame:
    """(a, b, cosine) with a < b."""
    return _searched(vectors, False, **options).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def groups(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, group_id): the vectors that have near ones, and the least vec_id of those that a chain of pairs leads to."""
    found = _searched(vectors, True, **options)
    return common.components(vectors.sparkSession, found.select("a", "b")).select(F.col("node").alias("vec_id"), F.col("root").alias("group_id"))
