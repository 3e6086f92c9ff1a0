import collections
import random

import numpy as np
import pytest
from lodestar.llm import suffix_dedup as s

SCHEMA = "doc_id long, text string, hash string, start long"


def brute(docs, n):
    where = collections.defaultdict(list)
    for row, (d, t) in enumerate(docs):
        w = (t or "").split()
        for i in range(len(w) - n + 1):
            where[tuple(w[i : i + n])].append((d, i, row))
    hit = collections.defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            lead = min(places)
            for k, (d, i, _) in enumerate(sorted(places)):
                hit[d].add((i, lead[0], k > 0))
    out = set()
    for d, windows in hit.items():
        spans = []
        for i in sorted({x[0] for x in windows}):
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + n
            else:
                spans.append([i, i + n])
        for a, b in spans:
            own = [x for x in windows if a <= x[0] < b]
            out.add((d, a, b, b - a, min(x[1] for x in own)))
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = ["a", "b", "the", "of", "é", "word", "other"] + [f"w{k}" for k in range(30)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    shared = [words(r.randint(15, 40)) for _ in range(6)]
    docs = []
    for k in range(60):
        body = words(r.randint(0, 80))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(body))
            body[at:at] = r.choice(shared)
        docs.append((k, r.choice([" ", "\n", "  "]).join(body)))
    docs += [(100, docs[7][1]), (101, "same " * 70), (102, docs[7][1])]
    df = spark.createDataFrame([(*d, "h", 1) for d in docs], SCHEMA)
    got = s.repeats(df, min_words=12, gram=3, bucket_rows=40).collect()
    assert {tuple(x)[:5] for x in got} == brute(docs, 12)
    assert len(got) == len({tuple(x)[:5] for x in got}) > 20
    assert {x.doc_id for x in got if x.source_doc_id == x.doc_id} and any(x.later_windows == 0 for x in got)


def test_mergesort_orders_suffixes():
    r = np.random.default_rng(0)
    symbols = r.integers(0, 3, 400)
    group = np.sort(r.integers(0, 9, 380))
    suffix = r.permutation(380)
    out = s.Sorter(symbols, 8).sort(suffix, group)
    for g in range(9):
        want = sorted(suffix[group == g], key=lambda x: tuple(symbols[x : x + 8]))
        assert [tuple(symbols[x : x + 8]) for x in out[group == g]] == [tuple(symbols[x : x + 8]) for x in want]


def test_cases(spark):
    long = " ".join(f"t{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, "short one"), (4, long), (5, "x " + long), (None, long), (7, "one " * 50), (8, "row " * 20 + " ".join(f"r{k}" for k in range(60))), (8, "row " * 20 + " ".join(f"r{k}" for k in range(60)))]
    df = spark.createDataFrame([(*x, "h", 0) for x in rows], SCHEMA)
    got = sorted(tuple(x) for x in s.repeats(df).collect())
    assert got == [(4, 0, 60_000, 60_000, 4, 0), (5, 1, 60_001, 60_000, 4, 59_951), (8, 0, 80, 80, 8, 31)]
    assert s.repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        s.repeats(df, gram=60)
