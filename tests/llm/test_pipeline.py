"""The stages against what brute force leaves of a small corpus."""

import random

import corpus_pipeline
import pytest

R = random.Random(12)
WORDS = [f"{a}{b}" for a in ("lor", "ip", "dol", "am", "con", "sec", "ad", "el") for b in ("em", "sum", "or", "et", "tur", "it", "a", "os")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    prose = lambda n: [R.choice(WORDS) for _ in range(n)]
    passage = " ".join(prose(30))
    docs, gone = {}, {}
    for k in range(300):
        docs[k] = (" ### " if k % 5 == 0 else " ").join(prose(R.randint(60, 150)))  # poor ones have signs
    labels = [(k, int(k % 5 > 0), 0) for k in range(0, 300, 2)]
    for k in range(300, 340):  # toxic
        w = prose(80)
        for bad in R.sample(["scumbag", "vermin", "moron"], 2):
            w.insert(R.randint(0, 80), bad)
        docs[k] = " ".join(w)
        labels.append((k, 1, 1))
        gone[k] = "toxicity"
    for k in range(340, 350):  # near copies, and a copy of each
        w = docs[k - 340].split()
        w[7] = "changed"
        docs[k], docs[k + 10] = " ".join(w), docs[k - 340]
        gone[k] = gone[k + 10] = "near_duplicates"
    for k in range(360, 366):
        docs[k] = " ".join([*prose(50), passage, *prose(50)])
        gone[k] = "decontamination"
    docs[370] = " ".join([*prose(50), "jane.roe4@mail2.example.com", *prose(50)])
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, docs, gone


def test_each_stage(spark, tables):
    at, docs, gone = tables
    now = spark.read.parquet(f"{at}/documents.parquet")
    columns = now.columns
    left = set(docs)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, at)
        if name != "mixing":
            assert out.columns == columns
        left -= {k for k in gone if gone[k] == name}
        out.write.parquet(f"{at}/{name}")
        now = spark.read.parquet(f"{at}/{name}")
        got = {x.doc_id: x.text for x in now.collect()}
        assert set(got) == left, name
    assert "[EMAIL]" in got[370] and "example.com" not in got[370]
    run = {x.doc_id: (x.text, x.rate) for x in corpus_pipeline.run(spark, at).collect()}
    assert {k: t for k, (t, _) in run.items()} == got and all(r > 0 for _, r in run.values())
