import random

import numpy as np

from demandspark.llm import quality


def test_separates_held_out_documents(spark, words):
    rng = random.Random(4)
    good = lambda: "\n".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() + "." for _ in range(rng.randint(1, 8)))
    bad = lambda: "\n".join(" ".join([rng.choice(words)] * 15) for _ in range(rng.randint(1, 8)))
    rows = [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(240)]
    rows += [(300, None, 1), (301, "", None), (302, "x" * 200_000, None), (303, "\n" * 5000, None), (0, rows[0][1], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").selectExpr("*", "1 AS score", "2 AS x")
    model = quality.learn(docs.filter("doc_id % 3 <> 0"))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert len(got) == 244 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows[:240] if i % 3 == 0]) > 0.97
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.learn(docs.filter("doc_id % 3 <> 0").repartition(5)).weights.tolist() == model.weights.tolist()


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, label int")
    assert [r["score"] for r in quality.score(docs, quality.learn(docs)).collect()] == [0.5]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    width = 3 * quality.N_OWN + 2
    model = quality.ChainModel(np.zeros(width), np.ones(width), rng.normal(size=width), 0.3, rng.normal(size=(2, 2)))
    text = "One line here.\n$$$ two\nthree three three\nFOUR"
    x, lengths = quality.line_features(text)
    logit = np.clip(x @ model.weights + model.bias, -12, 12)
    good, total = np.zeros(4), 0.0
    for mask in range(16):
        y = [mask >> i & 1 for i in range(4)]
        p = np.exp(sum(logit[i] * y[i] for i in range(4)) + sum(model.moves[y[i], y[i + 1]] for i in range(3)))
        total += p
        good += p * np.array(y)
    assert abs(model.score(text) - (good / total * lengths).sum() / lengths.sum()) < 1e-9
