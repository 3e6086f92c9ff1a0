"""Queries over texts: each text is read once, and counts, not words, are shuffled."""

import pytest
from lodestar import catalog
from lodestar.functions import secrets, text
from lodestar.operators import bm25
from lodestar.plans import render
from pyspark.sql import functions as F

TEXTS = ["HTTPServer fooBar foo_bar bar", "aB aB ab ab AB", "", None, "--- ", "x1 1x \u00c9cole\u00c9t\u00e9", "a a a b b a", "aa a a aa", "\u039f\u0394\u039f\u03a3 \u03a3\u03a3a", "  9 lives, 9Lives"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def words(spark):
    """The tokens of TEXTS."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string").orderBy("k")
    return [r.w for r in df.select(text.tokens(F.col("t")).alias("w")).collect()]


def test_call_fanout_against_a_plain_loop(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")
    assert [r.n for r in df.orderBy("k").select(text.first_token(F.col("t")).alias("n")).collect()] == [w[0] if w else None for w in words(spark)]
    for name, ids in (("once", list(range(len(TEXTS)))), ("repeated", [0, *range(len(TEXTS) - 1)])):
        d = tmp_path / name
        spark.createDataFrame(list(zip(ids, TEXTS, strict=True)), "doc_id int, text string").write.parquet(f"{d}/documents.parquet")
        each = list(zip(ids, words(spark), strict=True))
        nodes, calls = {(k, w[0]) for k, w in each if w}, {(k, x) for k, w in each for x in w[1:]}
        edges = {(a, k, n) for k, n in nodes for i, c in calls if c == n for a, _ in nodes if a == i and a != k}
        want = {(n, sum(e[2] == n for e in edges), len({e[0] for e in edges if e[2] == n})) for _, _, n in edges}
        got = catalog.call_fanout(spark, str(d))
        assert {tuple(r) for r in got.collect()} == want
        if name == "once":
            assert plan(got).count("Relation [") <= 2


@pytest.mark.parametrize("most", [1, 4 << 20])
def test_term_frequency_counts_in_place(spark, monkeypatch, most):
    whole = bm25._counted
    monkeypatch.setattr(bm25, "_counted", lambda each, key: whole(each, key, most))
    for ids in (list(range(len(TEXTS))), [None, None, 1, 1, 2, 3, 4, 4, 4, 5]):
        want = {}
        for k, w in zip(ids, words(spark), strict=True):
            for x in w:
                want[k, x] = want.get((k, x), 0) + 1
        got = bm25.term_frequency(spark.createDataFrame(list(zip(ids, TEXTS, strict=True)), "k int, t string"), "k", F.col("t"))
        assert {(r.k, r.term): r.tf for r in got.collect()} == want and got.count() == len(want)
        assert ("Aggregate" in plan(got)) == (None in ids)
    assert bm25.term_frequency(spark.createDataFrame([], "k int, t string"), "k", F.col("t")).count() == 0


def test_contract_view_makes_names_once(spark, tmp_path):
    spark.createDataFrame([(0, "s", "en", "One eye two"), (1, "s", "fr", "eye"), (2, "s", None, "b b a")], "doc_id int, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.contract_view(spark, str(tmp_path))
    assert {r.line for r in got.collect()} == {"- `s/0.rs`: one \u2014 en, two", "- `s/2.pyi`: b, a"}
    assert plan(got).count("Relation [") == 1 and plan(got).count("array_remove") == 1
    symbols = spark.createDataFrame([("a", [("public", None, None)]), ("b", [("private", "x", None)]), ("c", None)], "path string, symbols array<struct<visibility string, name string, docstring string>>")
    assert {tuple(r) for r in render.contract_view(symbols).collect()} == {("a", "- `a`: ")}


def test_secrets_are_those_of_all_patterns_in_turn(spark):
    found = {
        "private_key": "-----BEGIN RSA PRIVATE KEY-----\nab+/=\n-----END RSA PRIVATE KEY-----",
        "openai": "sk-" + "a" * 20,
        "github": "ghs_" + "a" * 30,
        "aws": "ASIA" + "A" * 16,
        "stripe": "rk_test_" + "a" * 16,
        "jwt": "eyJa.b.c",
        "database": "redis://u:p@h",
        "assignment": 'secret = "' + "a" * 12 + '"',
    }
    assert found.keys() == secrets.PATTERNS.keys() == secrets.HINTS.keys()
    texts = [*found.values(), " ".join(found.values()), "password = sk-" + "b" * 20, "mysql://u:" + found["openai"] + "@h", "sk-short token eyJ k_live_ ://", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t"), secrets.count(F.col("t")).alias("n"), secrets.redact(F.col("t")).alias("r"))
    left, want = F.col("t"), F.lit(0)
    for p in secrets.PATTERNS.values():
        left, want = F.regexp_replace(left, p, secrets.MARK), want + F.regexp_count(left, F.lit(p))
    assert all(r.n == r.want and r.r == r.left for r in df.select("*", left.alias("left"), want.alias("want")).collect())
    assert [r.n for r in df.limit(len(found)).collect()] == [1] * len(found)
    assert not any(h in secrets.MARK or set("[]") & set(h) for hints in secrets.HINTS.values() for h in hints)


def test_secret_scan_counts_only_where_there_are_secrets(spark, tmp_path):
    spark.createDataFrame([(0, "sk-" + "a" * 20), (1, "sk-a"), (2, None)], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.secret_scan_documents(spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [(0, 1)]
    kept = [line for line in plan(got).splitlines() if "Filter" in line]
    assert kept and not any("regexp_replace" in line for line in kept)
