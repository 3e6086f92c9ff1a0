import random

import numpy as np
from lodestar.llm import toxicity as t

SCHEMA = "doc_id long, text string, toxic string, word long"


def corpus(n=1500):
    r = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    seen, unseen = [f"insult{k}" for k in range(6)], [f"slur{k}" for k in range(4)]
    rows, truth = [], {}
    for k in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(5, 120))]
        truth[k] = int(r.random() < 0.15)
        if truth[k]:
            # Slurs are in no labelled document; they come with insults elsewhere, or alone.
            pool = seen if k % 3 == 0 else seen + unseen if k % 3 == 1 else unseen
            for _ in range(4):
                w.insert(r.randint(0, len(w)), r.choice(pool).upper() + "!")
        rows.append((k, " ".join(w), "x", 1))
    labels = [(k, truth[k]) for k in truth if k % 3 == 0]
    return rows, labels, truth


def test_induction_finds_words_that_no_label_has(spark):
    rows, labels, truth = corpus()
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = t.induce(docs, labels)
    weight = dict(zip(lexicon.words, lexicon.weights, strict=True))
    assert all(weight.get(f"insult{k}", 0) > 0.5 for k in range(6)) and all(weight.get(f"slur{k}", 0) > 0.3 for k in range(4))
    got = {x.doc_id: x.score for x in t.toxic_documents(docs, labels).collect()}
    held = [k for k in truth if k % 3]
    assert np.mean([truth[k] == (k in got) for k in held]) > 0.99
    assert t.toxic_documents(docs, labels, limit=0).count() == len(got)  # the way beyond the limit
    far = t.induce(docs, labels, most_nodes=0, steps=8)
    near = t.induce(docs, labels, steps=8)
    assert far.words == near.words and np.allclose(far.weights, near.weights, atol=1e-9)
    kept = t.without_toxic(docs, labels)
    assert kept.schema == docs.schema and {x.doc_id for x in kept.collect()} == set(truth) - set(got)


def test_words_of_unrelated_texts_stand_beside_copies(spark):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    hot = [*words(20), "slur", *(f"rare{k}" for k in range(20)), *words(20)]
    toxic = [[*words(r.randint(5, 60)), "slur", *words(9)] for _ in range(50)]
    toxic += [[*words(20), "damn", "phrase", *words(20)] for _ in range(40)] + [["long"] + ["again"] * 5000 + words(20)] + [[*words(9), "again", *words(9)] for _ in range(40)]
    toxic += [list(hot) for _ in range(300)] + [[r.choice(vocabulary) if r.random() < 0.05 else w for w in hot] for _ in range(200)]
    clean = [words(r.randint(5, 120)) for _ in range(900)]
    rows = [(k, " ".join(w), "x", 1) for k, w in enumerate(toxic + clean)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(k, int(k < len(toxic))) for k in range(len(rows)) if k % 2 or k >= 630], "doc_id long, toxic int")
    every = spark.createDataFrame([(k, int(k < len(toxic))) for k in range(len(rows))], "doc_id long, toxic int")
    for known in (every, labels):
        lexicon = t.induce(docs, known)
        weight = dict(zip(lexicon.words, lexicon.weights, strict=True))
        assert all(weight.get(w, 0) > 0 for w in ("slur", "phrase", "again"))
        assert not any(weight.get(f"rare{k}", 0) > 0 for k in range(20))


def test_walk_against_matrix():
    r = np.random.default_rng(1)
    m = np.triu(r.random((12, 12)) * (r.random((12, 12)) < 0.5), 1)
    m[:, 11] = 0
    i, j = np.nonzero(m)
    s = np.eye(12)[3]
    full = m + m.T
    p = full / np.maximum(full.sum(1, keepdims=True), 1e-12)
    x = s
    for _ in range(500):
        y = 0.85 * (x @ p)
        x = y + s * (1 - y.sum())
    assert np.allclose(x, t.walk(i, j, m[i, j], s, 0.15, 500))


def test_cases(spark):
    rows, labels, truth = corpus(600)
    rows += [(9000, None, "x", 1), (9001, "", "x", 1), (9002, "insult1 " * 100_000, "x", 1), (None, "insult1 insult2 insult3", "x", 1), (9002, "w1", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    odd = spark.createDataFrame([*labels, (None, 1), (5, None), (9001, 0), (777_777, 1)], "doc_id long, toxic int")
    got = {x.doc_id for x in t.toxic_documents(docs, odd).collect()}
    assert 9002 in got and not {9000, 9001, None} & got
    kept = [x.doc_id for x in t.without_toxic(docs, odd).collect()]
    assert kept.count(9002) == 1 and 9000 in kept and 9001 in kept and None not in kept
    for d, l in ((docs.limit(0), odd), (docs, odd.limit(0)), (docs, odd.where("toxic = 0"))):
        assert t.toxic_documents(d, l).count() == 0 and t.without_toxic(d, l).count() == d.count()
