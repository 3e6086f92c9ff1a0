import numpy as np
import pytest
from lodestar.llm import embeddings as e

SCHEMA = "vec_id long, embedding array<float>, label int, shard string"


def clustered(n=900, dim=24, seed=0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 3, dim))
    near = base[r.integers(0, len(base), n - len(base) - 60)]
    near = near + r.normal(size=near.shape) * r.choice([0.05, 0.2, 0.6], (len(near), 1))
    crowd = base[:1] + r.normal(size=(60, dim)) * 0.02  # more neighbours than a beam holds
    v = np.vstack((base, near, crowd)).astype(np.float32)
    return v[r.permutation(len(v))]


def brute(v, t):
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    return {(a, b): s[a, b] for a, b in zip(*np.nonzero(np.triu(s >= t, 1)), strict=True)}


def test_recall_against_brute_force(spark):
    v = clustered()
    df = spark.createDataFrame([(k, x.tolist(), 0, "s") for k, x in enumerate(v)], SCHEMA)
    want = brute(v, 0.95)
    got = {(x.a, x.b): x.cosine for x in e.near_pairs(df, shard_rows=300, beam=8).collect()}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) > 1500
    assert all(abs(want[p] - c) < 1e-6 for p, c in got.items())
    roots = {x.vec_id: x.group_id for x in e.groups(df, shard_rows=300).collect()}
    parent = list(range(len(v)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    truth = {k: find(k) for p in want for k in p}
    assert np.mean([roots.get(k) == r for k, r in truth.items()]) > 0.97


def test_graph_is_connected_enough_and_audit_widens():
    v = clustered(600, seed=3)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.arange(len(u))
    g = e.Graph(u, e._level(ids, 6), 6)
    assert len(g.levels) > 1
    want = brute(v, 0.9)
    r, c, beam = e.audited(g, ids, ids, u, 0.9, 1, 1.0, 200)
    got = {(min(a, b), max(a, b)) for a, b in zip(r, c, strict=True) if a != b}
    assert len(got & set(want)) >= 0.97 * len(want) and beam > 1


def test_cases(spark):
    x = [1.0, 2.0, 3.0]
    rows = [(1, x), (2, [2.0, 4.0, 6.0]), (2, [2.0, 4.0, 6.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 1.0]), (7, [1.0, None, 3.0]), (None, x), (8, [1.0, 2.0]), (9, [1.0, 2.0]), (10, [-1.0, -2.0, -3.0])]
    df = spark.createDataFrame([(a, b, 0, "s") for a, b in rows], SCHEMA)
    assert sorted((t.a, t.b, round(t.cosine, 6)) for t in e.near_pairs(df).collect()) == [(1, 2, 1.0), (8, 9, 1.0)]
    assert sorted(tuple(t) for t in e.groups(df).collect()) == [(1, 1), (2, 1), (8, 8), (9, 8)]
    assert e.groups(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        e.near_pairs(df, threshold=0)


def test_every_vertex_is_seen_once():
    v = clustered(600, seed=5)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    g = e.Graph(u, e._level(np.arange(len(u)), 6), 6)
    ids, _ = g.search(u, 40)
    assert all(len(set(row[row >= 0])) == (row >= 0).sum() for row in ids)


def test_the_audit_has_something_to_find_without_near_vectors():
    u = np.random.default_rng(6).normal(size=(800, 32))
    u = (u / np.linalg.norm(u, axis=1, keepdims=True)).astype(np.float32)
    ids = np.arange(len(u))
    p = e.probes(u, ids, 0.9, 50)
    assert p.shape == (50, 32) and np.allclose((p @ u.T).max(axis=1), 0.9, atol=1e-3)
    g = e.Graph(u, e._level(ids, 3), 3)
    for row in g.levels:  # a graph that leads nowhere
        row[:] = -1
    assert e.audited(g, ids, ids, u, 0.9, 2, 0.97, 50)[2] > 2


def unit(v):
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def linked(n, a, b):
    return e.common.roots(n, np.asarray(a, int), np.asarray(b, int))


@pytest.mark.parametrize("lean", [0, 1.5])
def test_comparisons_grow_less_than_the_square_and_pairs_meet(lean):
    r = np.random.default_rng(8)
    counts = []
    for n in (4000, 16000):
        base = r.normal(size=(n * 3 // 4, 48)) + lean
        at = unit(base)[r.integers(0, len(base), n - len(base))]
        noise = unit(r.normal(size=at.shape)) * r.uniform(0.05, 0.32, (len(at), 1))
        u = unit(np.vstack((base, at + noise)))[r.permutation(n)]
        index = e.fit(u[: e.CHECKS + 2048], n, shard_rows=50, copy=0)
        member = e._gaps(u, index) <= index.slack
        size = member.sum(axis=0)
        assert member.any(axis=1).all() and size.sum() <= 8 * n
        counts.append((size.astype(float) ** 2).sum() / 2 + n * len(index.pivots))
        a, b = np.array(sorted(brute(u, 0.95))).T
        assert len(a) > n / 10 and (member[a] & member[b]).any(axis=1).mean() >= 0.97
    # The old form compared or searched n rows in n / 20,000 shards: 16 times as much.
    assert counts[1] < 4**1.75 * counts[0] and counts[1] < 16000**2 / 8


def test_crowds_are_linked_as_all_pairs_would():
    r = np.random.default_rng(9)
    one, two = unit(r.normal(size=(2, 24)))
    beside = one + 0.45 * unit((two - (two @ one) * one)[None, :])[0]  # its crowd touches that of `one` here and there
    v = np.vstack([c + s * r.normal(size=(300, 24)) for c, s in ((one, 0.02), (beside, 0.03), (two, 0.05))] + [r.normal(size=(300, 24)), one + 0.08 * r.normal(size=(200, 24))])
    v = v[r.permutation(len(v))].astype(np.float32)
    for threshold in (0.8, 0.95, 0.99, 1.0):
        want = linked(len(v), *np.array(sorted(brute(v, threshold - 1e-12)), int).reshape(-1, 2).T)
        for crowd in (100, 10_000):
            got = np.arange(len(v))
            root, row, _, _ = e.forest(v, np.arange(len(v)), threshold, crowd=crowd)
            got[row] = root
            assert (got == want).all(), (threshold, crowd)
    root, row, _, _ = e.forest(v, np.arange(len(v)), 0.95, crowd=10_000, graph_rows=500)
    got, want = np.arange(len(v)), linked(len(v), *np.array(sorted(brute(v, 0.95))).T)
    got[row] = root
    assert (got == want).mean() >= 0.97


def test_groups_over_cells_and_lengths(spark):
    v, w = clustered(6000, 24, seed=10), clustered(3000, 12, seed=11)
    rows = [(k, x.tolist(), 0, "s") for k, x in enumerate(v)] + [(10_000 + k, x.tolist(), 0, "s") for k, x in enumerate(w)]
    df = spark.createDataFrame(rows, SCHEMA)
    u = unit(v)
    index = e.fit(u[: e.CHECKS + 2048], len(v), shard_rows=100)
    assert len(index.pivots) > 2
    got = {x.vec_id: x.group_id for x in e.groups(df, shard_rows=100).collect()}
    want = {}
    for x, base in ((v, 0), (w, 10_000)):
        pairs = np.array(sorted(brute(x, 0.95))).T
        root = linked(len(x), *pairs)
        want |= {base + int(k): base + int(root[k]) for k in np.unique(pairs)}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) > 1000
    assert np.mean([got.get(k) == g for k, g in want.items()]) >= 0.95


def test_pairs_that_rounding_leaves_open_are_decided_by_the_vectors(spark):
    r = np.random.default_rng(12)
    x = r.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = 0.95 + r.uniform(-3e-5, 3e-5, (len(x), 1))
    v = np.vstack((x, c * x + np.sqrt(1 - c * c) * z)).astype(np.float32)
    want = linked(len(v), *np.array(sorted(brute(v, 0.95))).T)
    df = spark.createDataFrame([(k, t.tolist(), 0, "s") for k, t in enumerate(v)], SCHEMA)
    got = np.arange(len(v))
    for t in e.groups(df).collect():
        got[t.vec_id] = t.group_id
    assert (got == want).all() and 100 < (want[400:] < 400).sum() < 300
    q = np.round(v / np.linalg.norm(v, axis=1, keepdims=True) * e.ROUND).astype(np.float32) / e.ROUND
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    assert np.abs(q @ q.T - u @ u.T).max() < e.margin(64)
