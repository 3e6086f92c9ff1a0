import random

import numpy as np
import pytest
from lodestar.llm import mixing as m

SCHEMA = "doc_id long, text string, rate string, high long"


def corpus(n=800):
    r = random.Random(6)
    rows, labels, truth = [], [], {}
    for k in range(n):
        d = r.choices([0, 1, 2], [0.5, 0.35, 0.15])[0]
        pool = ([f"good{j}" for j in range(50)], [f"junk{j}" for j in range(20)], [f"bad{j}" for j in range(20)])[d] + ["the", "of", "and"] * 8
        sign = "### " if d == 1 else " "
        rows.append((k, sign.join(r.choice(pool) for _ in range(r.randint(3, 150))), "x", 1))
        truth[k] = d
        if k % 2:
            labels.append((k, int(d != 1), int(d == 2)))
    return rows, labels, truth


def test_posteriors_and_totals(spark):
    rows, labels, truth = corpus()
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = {"high": 0.6, "low": 0.2, "toxic": 0.2}
    got = m.rates(docs, labels, want).toPandas().set_index("doc_id").sort_index()
    p = got[[f"p_{d}" for d in m.DOMAINS]].to_numpy()
    held = [k for k in truth if k % 2 == 0]
    assert np.mean(p[held].argmax(1) == [truth[k] for k in held]) > 0.97
    n, r = got.n_words.to_numpy(), got.rate.to_numpy()
    assert (r >= 0).all() and np.allclose((p * (n * r)[:, None]).sum(0) / n.sum(), [0.6, 0.2, 0.2], atol=2e-3)
    # as good as long descent in one place
    a, b = (p * n[:, None]).T, n.sum() * np.array([0.6, 0.2, 0.2])
    x = np.ones(len(n))
    for _ in range(3000):
        x = np.maximum(0, x - 0.5 * p @ ((a @ x - b) / a.sum(1)))
    assert np.abs(a @ r - b).sum() <= np.abs(a @ x - b).sum() + 2e-3 * n.sum()
    mixed = m.mix(docs, labels, want)
    assert mixed.columns == ["doc_id", "text", "high", "rate", "copies"]
    out = mixed.toPandas().set_index("doc_id")
    assert set(out.index) == set(got.index[got.rate > 0]) and (np.abs(out.copies - out.rate) < 1).all()
    assert abs((out.copies * n[out.index]).sum() / n.sum() - 1) < 0.1


def test_zero_weight_takes_rates_to_the_bound(spark):
    rows, labels, truth = corpus(400)
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = m.rates(docs, labels, {"high": 1.0}).toPandas().set_index("doc_id").rate
    assert np.mean([got[k] for k in truth if truth[k] == 2]) < 0.1 < np.mean([got[k] for k in truth if truth[k] == 0])


def test_cases(spark):
    rows, labels, _ = corpus(200)
    rows += [(900, None, "x", 1), (901, "", "x", 1), (902, "good1 " * 100_000, "x", 1), (None, "good1 good2", "x", 1), (3, rows[3][1], "x", 1), (904, "éé 中文  ", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    odd = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (6, 1, None), (7, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in m.rates(docs, odd).collect()}
    assert len(got) == 204 and got[900].rate == got[901].rate == 1.0 and got[900].n_words == 0 and got[902].n_words == 100_000
    assert m.rates(docs.limit(0), odd).count() == 0 and m.mix(docs.limit(0), odd).count() == 0
    bare = m.rates(docs, odd.limit(0)).collect()
    assert all(abs(x.p_low - 1 / 3) < 1e-5 for x in bare) and len({x.rate for x in bare if x.n_words}) == 1
    with pytest.raises(ValueError):
        m.rates(docs, odd, {"high": 0.0})
