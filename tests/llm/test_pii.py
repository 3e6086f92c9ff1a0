import itertools
import random

import numpy as np
import pytest
from lodestar.llm import pii

SCHEMA = "doc_id long, text string, n_chars long, kind string"
WORDS = [w + e for w in ("lorem", "ipsum", "dolor", "amet", "être", "straße", "año", "the", "of") for e in ("", "s", "ing", "ed")]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    r = random.Random(4)
    return pii.train([prose(r, 400) for _ in range(20)], rounds=350)


def test_gradients_against_differences():
    m = pii._new(3, 1)
    x, y = pii.examples(["some words to put spans into"], 4, 14, 3)
    _, grads = pii.loss_and_gradients(m, x, y)
    for a, g in zip(m.arrays(), grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        was = a[at]
        a[at] = was + 1e-5
        up, _ = pii.loss_and_gradients(m, x, y)
        a[at] = was - 1e-5
        down, _ = pii.loss_and_gradients(m, x, y)
        a[at] = was
        assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_viterbi_against_all_paths():
    r = np.random.default_rng(0)
    m = pii._new(3, 2)
    m.moves, m.first = r.normal(0, 1, m.moves.shape), r.normal(0, 1, m.first.shape)
    scores = r.normal(0, 1, (4, len(pii.KINDS), 5)).astype(np.float32)
    scores[:, 0, :2] += 20  # windows that need no decoding
    got = m.viterbi(scores)
    for w in range(5):
        value = lambda p: m.first[p[0]] + sum(scores[t, k, w] for t, k in enumerate(p)) + sum(m.moves[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
        assert tuple(got[:, w]) == max(itertools.product(range(len(pii.KINDS)), repeat=4), key=value)


def test_held_out_accuracy(model):
    x, y = pii.examples([prose(random.Random(9), 3000)], 300, pii.WIDTH, 123)
    k = model.viterbi(model.emissions(x))
    hit = (k == y) & (y > 0)
    assert hit.sum() / (k > 0).sum() > 0.95 and hit.sum() / (y > 0).sum() > 0.95


def test_windows_are_reconciled(model):
    """The same span is found wherever it lies against the windows."""
    r = random.Random(3)
    found = 0
    for at in range(200, 330, 3):
        text = (prose(r, 80))[:at].rstrip() + " jane.doe22@mail.example.com " + prose(r, 30)
        start = text.index("jane")
        found += any(s <= start + 2 and e >= start + 20 and pii.KINDS[k] == "EMAIL" for s, e, k in zip(*model.decode([text])[1:], strict=True))
    assert found >= 40


def test_spark(spark, model):
    r = random.Random(8)
    mail = prose(r, 30) + " bob.smith7@mail3.example.com " + prose(r, 30)
    long = prose(r, 30_000) + " +1 (555) 123-4567 " + prose(r, 10)
    rows = [(1, None), (2, ""), (3, mail), (3, mail), (None, mail), (4, long), (5, prose(r, 50))]
    df = spark.createDataFrame([(a, b, len(b) if b is not None else None, "k") for a, b in rows], SCHEMA)
    got = sorted(tuple(x) for x in pii.spans(df, model).collect())
    assert [(g[0], g[3]) for g in got] == [(3, "EMAIL"), (4, "PHONE")]
    assert mail[got[0][1] : got[0][2]] == "bob.smith7@mail3.example.com" and long[got[1][1] : got[1][2]] == "+1 (555) 123-4567"
    out = pii.redact(df, model)
    assert out.schema == df.schema
    kept = sorted((tuple(x) for x in out.collect()), key=lambda x: (x[0] or 0, x[1] or ""))
    assert len(kept) == len(rows) and [x[1] for x in kept if x[0] in (None, 3)] == [mail.replace("bob.smith7@mail3.example.com", "[EMAIL]")] * 3
    assert all(x[2] == (len(x[1]) if x[1] is not None else None) for x in kept) and kept[1][1] is None
    assert pii.spans(df.limit(0), model).count() == 0 and pii.redact(df.limit(0), model).count() == 0
    assert pii.fit(df.limit(0), rounds=2) is not None
