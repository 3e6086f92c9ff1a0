import itertools
import random

import pyarrow as pa
import pytest
from lodestar.llm import common, jaccard, queries

SCHEMA = "doc_id long, text string, grp string, token string"


def grams(text, n=3):
    w = "".join(c.lower() if c.isalnum() else " " if ord(c) < 128 else c for c in text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(1)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(3000)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage = words(40)
    docs = []
    for _ in range(25):
        base = words(r.randint(8, 400))
        docs.append(base)
        for _ in range(r.randint(0, 5)):
            docs.append([r.choice(vocabulary) if r.random() < 0.06 else w for w in base])
        if r.random() < 0.4:
            docs += [base, base]
    docs += [words(150) + passage + words(100) for _ in range(40)]
    docs = [" ".join(d) for d in docs]
    r.shuffle(docs)
    return list(enumerate(docs))


def brute(rows):
    """(similarities of the pairs that reach the threshold, the least document of each one's component)"""
    sets = {k: grams(t) for k, t in rows}
    sets = {k: s for k, s in sets.items() if s}
    want = {(a, b): j for a, b in itertools.combinations(sorted(sets), 2) if (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.5}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return sets, want, find


def summary(rows):
    """What classes() gives for these, by brute force."""
    sets, want, find = brute(rows)
    of = {k: min(o for o in sets if sets[o] == sets[k]) for k in sets}
    out = {}
    for k in sets:
        linked = {of[b if a == k else a] for a, b in want if k in (a, b)} - {of[k]}
        copies = sum(of[o] == of[k] for o in sets)
        if copies > 1 or linked:
            out[k] = (of[k], copies, len(linked), find(k))
    return out


@pytest.mark.parametrize("options", [{}, {"block_rows": 3, "asks": 0}, {"block_tokens": 700}])
def test_every_pair_and_its_value(spark, corpus, options):
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in corpus], SCHEMA)
    _, want, find = brute(corpus)
    got = {(x.doc_a, x.doc_b): x.jaccard for x in jaccard.pairs(df, expand=True, **options).collect()}
    assert set(got) == set(want) and len(want) > 30
    assert all(abs(want[p] - j) < 1e-9 for p, j in got.items())
    rows = {x.doc_id: (x.class_id, x.copies, x.links, x.group_id) for x in jaccard.classes(df, **options).collect()}
    assert rows == summary(corpus)
    if not options:
        short = {(x.doc_a, x.doc_b) for x in jaccard.pairs(df).collect()}
        roots = {x.node: x.root for x in common.components(spark, spark.createDataFrame(list(short), "a long, b long")).collect()}
        assert roots == {k: find(k) for p in got for k in p}
        kept = {x.doc_id for x in jaccard.one_of_each(df).collect()}
        assert kept == {k for k, _ in corpus if find(k) == k}


def test_large_groups_of_near_copies(spark):
    r = random.Random(8)
    base = [f"w{r.randint(0, 900)}" for _ in range(90)]
    rows = []
    for k in range(160):
        w = list(base)
        for _ in range(r.randint(1, 9)):
            w[r.randrange(90)] = f"x{r.randint(0, 9)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], SCHEMA)
    want = summary(rows)
    for options in ({}, {"block_rows": 40}):
        assert {x.doc_id: (x.class_id, x.copies, x.links, x.group_id) for x in jaccard.classes(df, **options).collect()} == want


def test_token_sets_of_many_texts():
    texts = pa.array([f"a b c d{k % 7} {k}" for k in range(66_000)])
    tokens, off = jaccard.token_sets(texts, 3)
    assert len(off) == 66_001 and (off[1:] - off[:-1] == 3).all()
    alone, _ = jaccard.token_sets(texts.slice(65_990, 1), 3)
    assert (tokens[off[65_990] : off[65_991]] == alone).all()


def test_cases(spark):
    long = " ".join(f"t{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, "!!! ..."), (4, "Two words"), (5, "two, WORDS!"), (5, "two, WORDS!"), (None, "two words"), (7, long), (8, long + " end"), (9, "something else entirely here")]
    df = spark.createDataFrame([(a, b, "g", "t") for a, b in rows], SCHEMA)
    got = sorted(tuple(x) for x in jaccard.pairs(df).collect())
    assert [x[:2] for x in got] == [(4, 5), (7, 8)] and got[0][2] == 1.0 and abs(got[1][2] - 59_998 / 59_999) < 1e-9
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns and sorted(x.doc_id or 0 for x in kept.collect()) == [0, 1, 2, 3, 4, 7, 9]
    assert jaccard.pairs(df.limit(0)).count() == 0
    assert jaccard.one_of_each(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        jaccard.pairs(df, threshold=0)


def test_query_gives_a_row_for_each_document_with_a_partner(spark, tmp_path):
    r = random.Random(4)
    base = [f"w{r.randint(0, 500)}" for _ in range(120)]
    near = [*base[:60], "other", *base[61:]]
    texts = [base, base, base, base, near, near, [f"v{k}" for k in range(50)]]
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    spark.createDataFrame([(k, t, "g", "t") for k, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.class_id, x.copies, x.links, x.group_id) for x in queries.op8_ngram_jaccard_join(spark, str(tmp_path)).collect()}
    assert got == summary(rows) == {0: (0, 4, 1, 0), 1: (0, 4, 1, 0), 2: (0, 4, 1, 0), 3: (0, 4, 1, 0), 4: (4, 2, 1, 0), 5: (4, 2, 1, 0)}


def test_a_doc_id_with_several_texts(spark):
    r = random.Random(6)
    one, two = ([f"{c}{r.randint(0, 500)}" for _ in range(60)] for c in "ab")
    near = lambda w: [*w[:30], "new", *w[31:]]
    rows = [(1, one), (1, two), (1, one), (2, near(one)), (3, near(two)), (4, near(one)), (1, near(one))]
    df = spark.createDataFrame([(k, " ".join(w), "g", "t") for k, w in rows], SCHEMA)
    got = {(x.doc_a, x.doc_b) for x in jaccard.pairs(df, expand=True).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (2, 4), (2, 3), (3, 4)}  # 2 and 4 are in a class that is named by 1, as that of 3's partner is
    assert {x.doc_id for x in jaccard.one_of_each(df).collect()} == {1}
