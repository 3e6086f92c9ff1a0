"""Small cases of the engine's operators: nulls, empty tables, ties, repeats, and columns with clashing names."""

import numpy as np
import pytest
from lodestar.functions import bpe, paths, text
from lodestar.operators import bm25, graph, intervals, resolve, slicing
from lodestar.parse.model import Symbol
from lodestar.parse.spark import parse_one
from lodestar.plans import strategies, topology
from lodestar.sources.repository import Limits, admit, ignored
from pyspark.sql import functions as F


def rank(n, edges, rounds=200):
    out, score = np.bincount([a for a, _ in edges], minlength=n), np.full(n, 1 / n)
    for _ in range(rounds):
        new = np.full(n, 0.15 / n + 0.85 * score[out == 0].sum() / n)
        for a, b in edges:
            new[b] += 0.85 * score[a] / out[a]
        score = new
    return score


@pytest.mark.parametrize("small", [0, 2_000_000])
def test_page_rank_leaves_out_unknown_ends(spark, small):
    nodes = spark.createDataFrame([(0,), (1,), (2,), (3,), (3,), (None,)], "node int")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 3), (0, 9), (8, 1), (None, 1), (1, None)], "src int, dst int")
    got = {r.node: r.score for r in graph.page_rank(nodes, edges, small=small).collect()}
    want = rank(4, [(0, 1), (1, 2), (2, 0), (0, 3)])
    assert sorted(got) == [0, 1, 2, 3] and abs(sum(got.values()) - 1) < 1e-6
    assert all(abs(got[k] - want[k]) < 1e-5 for k in range(4))
    assert graph.page_rank(nodes.limit(0), edges, small=small).count() == 0
    alone = graph.page_rank(nodes, edges.limit(0), small=small).collect()
    assert len(alone) == 4 and all(abs(r.score - 0.25) < 1e-9 for r in alone)


def test_dense_ids_keep_columns(spark):
    rows = spark.createDataFrame([("b", 7, 1, 5), ("a", 8, 2, 5), (None, 9, 3, 5)], "name string, part int, base int, NODE int")
    got = {r["name"]: (r.part, r.base, r.node) for r in graph.dense_ids(rows, "name").collect()}
    assert got == {None: (9, 3, 0), "a": (8, 2, 1), "b": (7, 1, 2)}
    assert graph.dense_ids(rows.limit(0), "name").count() == 0


def levels(plans, budget):
    out, left = {}, budget
    for file_id, f, s, g, imp, hub, first in sorted(plans, key=lambda p: (-(float("inf") if p[1] == 0 else p[4] / p[1]), p[0])):
        level = 3 if first >= 3 and f <= left else 2 if first >= 2 and (s <= left or hub) else 1 if first >= 1 and g <= left else 2 if hub else 0
        left = max(0, left - {3: f, 2: s, 1: g, 0: 0}[level])
        out[file_id] = level
    return out


def test_allocate_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    plans = [(k, int(f), int(f) // 2, int(g), float(i), bool(h), int(l)) for k, (f, g, i, h, l) in enumerate(zip(rng.integers(0, 50, 400), rng.integers(1, 9, 400), rng.integers(0, 4, 400), rng.random(400) < 0.1, rng.integers(0, 4, 400), strict=True))]
    df = spark.createDataFrame(plans, "file_id int, full_tokens long, skeleton_tokens long, signature_tokens long, importance double, is_hub boolean, level int")
    for budget in (1, 200, 2_000, 1 << 40):
        assert {r.file_id: r.level for r in slicing.allocate(df, budget).collect()} == levels(plans, budget)
    assert slicing.allocate(df.limit(0), 10).count() == 0 and {r.level for r in slicing.allocate(df, 0).collect()} == {0}
    nulls = spark.createDataFrame([(1, None, None, None, None, None, None)], df.schema)
    assert slicing.allocate(nulls, 10).first().level == 0


def test_search_reads_texts_once(spark):
    docs = spark.createDataFrame([(1, "alphaBeta beta gamma", 1.0), (2, "beta", 2.0), (2, "beta", 2.0), (3, None, 0.0), (4, "", 0.0)], "id int, text string, score double")
    got = [(r.id, round(r.score, 6)) for r in bm25.search(docs, "id", F.col("text"), "beta Alpha", 5).collect()]
    assert [k for k, _ in got] == [1, 2, 2] and got[1] == got[2]
    assert bm25.search(docs, "id", F.col("text"), "  ", 5).count() == 0 and bm25.search(docs.limit(0), "id", F.col("text"), "beta", 5).count() == 0
    plan = bm25.search(docs, "id", F.col("text"), "alpha beta gamma", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_tokens(spark):
    rows = ["HTTPServer fooBar foo_bar bar", "aB aB ab ab AB", "", None, "--- ", "x1 1x ÉcoleÉté", "a a a b b a", "aa a a aa"]
    got = [r.w for r in spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").orderBy("k").select(text.tokens(F.col("t")).alias("w")).collect()]
    assert got == [["http", "server", "foo", "bar", "foo", "bar"], ["a", "b", "a", "b", "ab"], [], [], [], ["x1", "1x", "école", "été"], ["a", "b", "a"], ["aa", "a", "aa"]]


def test_call_counts_are_those_of_the_edges(spark):
    nodes = spark.createDataFrame([(k, f"p{k % 4}", f"n{k % 5}") for k in range(20)] + [(0, "p0", "n0"), (20, None, None)], "node int, path string, name string")
    calls = spark.createDataFrame([("p0", None, "n1"), ("p0", None, "n1"), ("p1", "n1", "n1"), ("p2", "n9", "n2"), ("p3", None, "n9"), ("p3", "n3", None), (None, None, "n1")], "path string, enclosing string, callee string")
    edges = resolve.call_edges(calls, nodes)
    assert edges.count() == edges.distinct().count() > 0
    named = edges.join(nodes.distinct(), edges.dst == nodes.node)
    want = {(r["name"], r.edges, r.callers) for r in named.groupBy("name").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("callers")).collect()}
    assert {tuple(r) for r in resolve.call_counts(calls, nodes).collect()} == want
    assert resolve.call_counts(calls, nodes.limit(0)).count() == resolve.call_edges(calls.limit(0), nodes).count() == 0


def test_intervals(spark):
    spans = spark.createDataFrame([("a", 1, 3, 0), ("a", 3, 5, 0), ("a", 1, 3, 0), ("a", 7, None, 0), ("a", None, 9, 0), (None, 1, 2, 0), ("a", 9, 8, 0)], "k string, start int, end int, _new int")
    assert {tuple(r) for r in intervals.interval_union(spans, "k").collect()} == {("a", 1, 5), ("a", 9, 9), (None, 1, 2)}


def test_admission(spark):
    raw = spark.createDataFrame([("a", bytearray(b"\xa0\x0b" * 3)), ("b", bytearray(b"\x10\x01\x00")), ("c", bytearray(b"x" * 600 + b"\x00")), ("d", None), ("e/" * 70 + "f", bytearray(b"")), ("g\0h", bytearray(b"")), ("i", bytearray(b"x" * 2000))], "path string, content binary").withColumn("length", F.octet_length("content"))
    got = {r.path: r.reason for r in admit(raw, Limits(max_file_size=1000)).collect()}
    assert got == {"a": "not_utf8", "b": "binary", "c": None, "d": None, "e/" * 70 + "f": "path_too_deep", "g\0h": "bad_path", "i": "too_large"}


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("a/*.py", "a/b.py", True), ("a/*.py", "a/c/b.py", False), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("**/x", "d/e/x", True), ("x/**", "x/y", True), ("[a-c].py", "q/b.py", True), ("[!a-c].py", "b.py", False), ("?.c", "ab.c", False), ("\\#a", "#a", True), ("a.py", "aXpy", False), ("[z-a]", "b", False), ("b/", "b/c", True), ("/b", "a/b", False)],
)
def test_ignore_patterns(pattern, path, hit):
    assert ignored(path, [("", pattern, False)]) == hit


def test_paths(spark):
    rows = [("a/b", "a//b/", True), ("a/b", "/a/b", False), ("a/./b", "a/b", False), ("/", "/", True), (None, "a", None), ("a/..", "a/..", True)]
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a string, b string, want boolean").orderBy("k").select(paths.same_path(F.col("a"), F.col("b")).alias("got"), paths.same_path(F.lit("a\\b"), F.lit("a/b"), windows=True).alias("w"), paths.normalise(F.lit("a\\b")).alias("n")).collect()
    assert [r.got for r in got] == [w for *_, w in rows] and got[0].w and got[0].n == "a\\b"


def test_derives_and_stripped_bodies():
    source = "#[derive(Clone, Copy)]\nstruct A { a: u8 }\nenum B { X }\n#[derive(Debug)]\nstruct C;\nfn f() { let x = \"#[derive(No)]\"; }\n"
    assert [(s.name, s.derives) for s in parse_one("rust", source).symbols] == [("A", ["Clone", "Copy"]), ("B", ["Clone", "Copy"]), ("C", ["Clone", "Copy", "Debug"]), ("f", [])]
    assert Symbol("class", "x", body_stripped=True).is_stripped and not Symbol("module", "x", body_stripped=True).is_stripped and not Symbol("class", "x").is_stripped


def test_vocabulary(spark, tmp_path):
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abab"]
    (tmp_path / "ranks").write_text("".join(f"{base64.b64encode(t).decode()} {k}\n" for k, t in enumerate(tokens)))
    rows = spark.createDataFrame([("ababab",), ("",), (None,), ("é",)], "t string")
    assert [r.n for r in rows.select(bpe.count_tokens(F.col("t"), str(tmp_path / "ranks")).alias("n")).collect()] == [2, 0, 0, 2]
    assert rows.select(bpe.count_tokens(F.lit("a b c")).alias("n")).first().n == 3


def test_own_strategy(spark, tmp_path):
    (tmp_path / "a.py").write_text("def f():\n    return 1\n")
    (tmp_path / "b.py").write_text("def g():\n    return f()\n")
    strategies.register_strategy("Names", lambda code: code.files.withColumn("level", F.lit(1)))
    try:
        out = topology.run(spark, str(tmp_path), topology.Options("names"))
    finally:
        del strategies.STRATEGIES["names"]
    assert "L1: function f" in out and "return" not in out
