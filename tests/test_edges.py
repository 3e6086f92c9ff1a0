"""Edges of the code graph against plain loops, in blocks of any size, and what their plans may not do."""

import re

import pytest
from lodestar.operators import graph, resolve


@pytest.fixture(params=[2, 1024])
def block(request, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", request.param)


NODES = [(k, f"p{k % 3}", f"n{k % 4}") for k in range(24)] + [(5, "p2", "n1"), (7, "p0", "n2"), (None, "p1", "n1"), (30, None, None)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def shuffles_edges(df):
    """Whether edges are made distinct after they are listed."""
    return bool(re.search(r"Aggregate \[src#\d+L?, dst#\d+L?", df._jdf.queryExecution().optimizedPlan().toString()))


def test_call_edges_of_nodes_with_two_names(spark, block):
    nodes = spark.createDataFrame(NODES, "node int, path string, name string")
    calls = [("p0", None, "n1"), ("p0", None, "n2"), ("p0", None, "n3"), ("p0", None, "n3"), ("p1", "n1", "n1"), ("p9", None, "n1"), (None, None, "n1"), ("p1", None, None)]
    want = {(s, t, "call") for path, inside, callee in calls for s, p, n in NODES for t, _, m in NODES if None not in (path, callee, s, t) and p == path and inside in (None, n) and m == callee and s != t}
    assert rows(resolve.call_edges(spark.createDataFrame(calls, "path string, enclosing string, callee string"), nodes)) == sorted(want)


def test_import_edges_are_listed_once(spark, block):
    nodes = spark.createDataFrame(NODES, "node int, path string, name string")
    imports = [("p0", "p1", []), ("p0", "p1", []), ("p0", "p1", ["n1"]), ("p2", "p2", ["n0", "n1", "n1"]), ("p2", "p0", ["n1", "n9"]), ("p1", "p9", []), (None, "p1", []), ("p1", None, [])]
    want = {(s, t, "import") for path, target, names in imports for s, p, _ in NODES for t, q, m in NODES if None not in (path, target, s, t) and p == path and q == target and (not names or m in names) and s != t}
    imports = spark.createDataFrame(imports, "path string, target string, names array<string>")
    assert rows(resolve.import_edges(imports, nodes)) == sorted(want)
    assert not shuffles_edges(resolve.import_edges(imports, nodes.where("node not in (5, 7)")))


def test_k_hop_makes_no_table_of_edges_distinct(spark, monkeypatch):
    monkeypatch.setattr(graph, "cut", lambda df: df)
    edges = spark.createDataFrame([(0, 1, "a"), (0, 1, "b"), (2, 1, "a"), (2, 3, "a"), (0, 9, "import"), (None, 0, "a"), (0, None, "a"), (3, 3, "a")], "src int, dst int, kind string")
    got = graph.k_hop(edges, spark.createDataFrame([(0,), (0,)], "node int"), 2)
    assert rows(got.where("node is not null")) == [(1, 1), (2, 2)]
    assert not re.search(r"Aggregate \[a#\d+, b#\d+", got._jdf.queryExecution().optimizedPlan().toString())


def test_parent_edges_of_repeated_parents(spark, block):
    nodes = spark.createDataFrame(NODES, "node int, path string, name string")
    parents = [("p0", "n1", "n2", "extends"), ("p0", "n1", "n2", "extends"), ("p0", "n1", "n2", "implements"), ("p2", "n1", "n1", "extends"), ("p9", "n1", "n2", "extends"), ("p0", "n0", None, "extends")]
    want = set()
    for path, name, parent, kind in parents:
        first = min((k for k, p, n in NODES if k is not None and (p, n) == (path, name)), default=None)
        want |= {(first, t, kind) for t, _, m in NODES if None not in (first, t, parent) and m == parent and t != first}
    parents = spark.createDataFrame(parents, "path string, name string, parent string, kind string")
    assert rows(resolve.parent_edges(parents, nodes)) == sorted(want)
    assert not shuffles_edges(resolve.parent_edges(parents, nodes.where("node not in (5, 7)")))
