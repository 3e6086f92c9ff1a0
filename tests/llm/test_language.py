import random

import numpy as np
import pytest
from lodestar.llm import language

SCHEMA = "doc_id long, text string, lang string, language long"
WORDS = {
    "en": "the of and to in that was with for from this which are his have not they thing being nothing together".split(),
    "de": "der die und ist nicht das ein eine mit für auf schön über zwischen straße durch werden kann größe".split(),
    "es": "el la que de los y en un una por con para está niño mañana también corazón después las como".split(),
}


def prose(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def network():
    r = random.Random(1)
    labels = [r.choice(sorted(WORDS)) for _ in range(120)]
    return language.train([prose(r, l, 60).encode() for l in labels], labels, rounds=120)


def test_gradients_against_differences():
    m = language.new_network(["a", "b", "c"], 4, 1)
    r = np.random.default_rng(0)
    x, y = r.integers(97, 110, (9, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, grads = language.loss_and_gradients(m, x, y)
    for a, g in zip(m.arrays(), grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        was = a[at]
        a[at] = was + 1e-5
        up, _ = language.loss_and_gradients(m, x, y)
        a[at] = was - 1e-5
        down, _ = language.loss_and_gradients(m, x, y)
        a[at] = was
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_held_out_accuracy_and_cases(spark, network):
    r = random.Random(2)
    truth = {k: r.choice(sorted(WORDS)) for k in range(200)}
    rows = [(k, prose(r, l, r.randint(3, 80))) for k, l in truth.items()]
    rows += [(900, None), (901, ""), (902, " \n "), (903, prose(r, "de", 30_000)), (None, "the of"), (3, rows[3][1])]
    df = spark.createDataFrame([(a, b, "en", 1) for a, b in rows], SCHEMA)
    got = {x.doc_id: (x.language, x.confidence) for x in language.identify(df, network).collect()}
    assert len(got) == 204 and got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] == "de"
    assert np.mean([got[k][0] == truth[k] for k in truth]) > 0.97
    assert language.identify(df.limit(0)).count() == 0
    none = language.identify(df.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {x.language for x in none} == {"und"}


def test_windows_agree_with_one_long_window(network):
    """Every byte is labelled once, whatever the windows."""
    text = prose(random.Random(3), "es", 12)[: language.WIDTH - 2 * language.MARGIN]
    x = np.frombuffer(text.encode(), np.uint8)
    s = network.scores(np.concatenate((np.zeros(language.MARGIN, np.uint8), x))[:, None])[language.MARGIN :, :, 0]
    import pyarrow as pa

    which, _ = network.label(pa.array([text]))
    keep = x != 32
    logp = s - np.log(np.exp(s).sum(1, keepdims=True))
    assert which[0] == logp[keep].mean(0).argmax()
