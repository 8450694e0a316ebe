import random

import numpy as np

from demandspark.llm import langid

SYLLABLES = {"aa": "ta ka mo ri shu", "bb": "zwe drö ßen üpf", "cc": "éau oix ñol íca"}


def texts(rng, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_and_cases(spark):
    rng = random.Random(2)
    rows = [(i, texts(rng, lang, rng.randint(5, 60)), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 !!", "cc"), (903, texts(rng, "aa", 40_000), None), (0, rows[0][1], "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS n")
    model = langid.learn(docs.filter("doc_id % 5 <> 1"))
    assert model.languages == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:180])
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[900]["score"] == 0
    assert langid.identify(docs.limit(0), model).count() == 0


def test_no_labelled_documents(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in langid.identify(docs, langid.learn(docs)).collect()] == ["und"]


def test_filter_has_no_false_negatives():
    values = langid.grams("some words of a text, with ünusual letters")
    masks = np.zeros((langid.ROWS, 1), np.uint64)
    for rows in langid.slots(values):
        masks[rows] |= np.uint64(1)
    assert langid.LanguageFilter(["xx"], masks).shares("some words of a text, with ünusual letters")[0] == 1.0


def test_grams_of_short_texts():
    assert len(langid.grams("a")) == 1 and not len(langid.grams("7")) and not len(langid.grams(None))


def test_texts_in_no_learnt_language_are_not_known(spark):
    rng = random.Random(4)
    other = "qx jv kw fp hg"
    rows = [(i, texts(rng, lang, rng.randint(8, 60)), lang) for i, lang in enumerate(list(SYLLABLES) * 40)]
    strange = [(500 + i, " ".join("".join(rng.choice(other.split()) for _ in range(3)) for _ in range(n)), None) for i, n in enumerate([3, 30, 300, 30_000])]
    strange += [(600, None, None), (601, "", None), (602, "12 !!", None)]
    docs = spark.createDataFrame(rows + strange, "doc_id long, text string, lang string").selectExpr("*", "1 AS known", "2 AS lang_pred")
    got = {r["doc_id"]: r["known"] for r in langid.recognise(docs, langid.learn(docs)).collect()}
    assert all(got[i] for i, _, _ in rows) and not any(got[i] for i, _, _ in strange)
    nothing = langid.learn(docs.filter("lang IS NULL"))
    got = {r["doc_id"]: r["known"] for r in langid.recognise(docs, nothing).collect()}
    assert all(known == (i not in (600, 601, 602)) for i, known in got.items())
    # chance hits alone: a filter with full rows explains everything
    full = langid.LanguageFilter(["xx"], np.full((langid.ROWS, 1), 1, np.uint64))
    assert full.known("any text at all") == ("xx", False)
