import random

from lodestar.llm import decontamination as d

SCHEMA = "doc_id long, text string, lang string, item_id string"


def longest(a, b):
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if (n, -i, -j) > (best[0], -best[1], -best[2]):
                best = (n, i, j)
    return best


def test_against_brute_force(spark):
    r = random.Random(3)
    words = ["a", "bb", "c", "é", "dd", "x1"]
    docs = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 60))), "en", "z") for k in range(60)]
    items = [(k, "  ".join(r.choice(words) for _ in range(r.randint(1, 12)))) for k in range(8)]
    items += [(100, " ".join(docs[5][1].split()[3:20]))]
    got = {(x.doc_id, x.item_id): (x.match_words, x.doc_word, x.item_word) for x in d.matches(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), min_words=5).collect()}
    want = {}
    for k, t, *_ in docs:
        for i, u in items:
            n, a, b = longest(t.split(), u.split())
            if n and n >= min(5, len(u.split())):
                want[k, i] = (n, a, b)
    assert got == want and want


def test_cases(spark):
    passage = " ".join(f"w{k}" for k in range(30))
    docs = [(1, None, None, "q"), (2, "", "en", "q"), (3, f"x\n{passage.replace(' ', chr(10))} y", "en", "q"), (3, f"x\n{passage} y", "en", "q"), (None, passage, "en", "q"), (5, "w1 " * 50_000, "en", "q"), (6, "tiny item", "en", "q")]
    docs = spark.createDataFrame(docs, SCHEMA)
    bench = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (None, passage), (4, "tiny item")], "item_id long, text string")
    got = sorted(tuple(x) for x in d.matches(docs, bench).collect())
    assert got == [(3, 1, 30, 1, 0), (6, 4, 2, 0, 0)]
    kept = d.decontaminate(docs, bench)
    assert kept.schema == docs.schema
    assert sorted(x.doc_id for x in kept.collect()) == [1, 2, 5]
    small = d.decontaminate(docs, bench, limit_bytes=100)  # the benchmark in parts
    assert sorted(x.doc_id for x in small.collect()) == [1, 2, 5]
    assert d.matches(docs.limit(0), bench).count() == 0 and d.matches(docs, bench.limit(0)).count() == 0
    assert d.decontaminate(docs, bench.limit(0)).count() == docs.count()
