"""Each stage of the pipeline by itself: nulls, repeats, empty tables, no languages, columns of any name."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
# names that stages and operators use inside, or used
NAMES = ["_score", "_language", "language", "known", "_was", "was", "_cut_id", "cut_id", "cut_key", "gone", "own_key", "_kept_id", "kept_id",
         "often_id", "_often_id", "row", "spans", "items", "n_words", "size", "node", "value", "taken", "target", "key", "score"]


@pytest.fixture(scope="module")
def docs(documents):
    narrow = documents.select("doc_id", "text", "lang", "source").withColumn("n_chars", F.length("text").cast("long"))
    return narrow.select("*", *[F.concat(F.lit(f"{name} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(name) for name in NAMES])


def own(rows):
    return Counter((r["doc_id"], *[r[n] for n in NAMES]) for r in rows)


@pytest.mark.parametrize("name", [n for n in STAGES if n != "mixing"])
def test_columns_stay_as_they_are(spark, docs, name):
    out = STAGES[name](spark, docs, SF)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    given = own(docs.collect())
    assert rows and not own(rows) - given
    assert all(r[n] == f"{n} {'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for n in NAMES)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)


def test_language(spark, docs):
    kept = {r["doc_id"] for r in STAGES["language"](spark, docs, SF).collect()}
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert ids - kept == {40, 41, 42, 43}


def test_without_languages_all_lettered_documents_stay(spark, docs):
    plain = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = {r["doc_id"] for r in STAGES["language"](spark, plain, SF).collect()}
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} - kept == {40, 41, 42, 43}


def test_near_duplicates(spark, docs):
    rows = STAGES["near_duplicates"](spark, docs, SF).collect()
    kept = Counter(r["doc_id"] for r in rows)
    # 45 shouts what 1 says, 47 what 46 says; the rows of 48 are one, a copy of 2
    assert {0, 1, 2, 40, 41, 42, 44, 46} <= set(kept) and not {45, 47, 48} & set(kept)
    # rows without an id stay if one of them does
    assert max(n for i, n in kept.items() if i is not None) == 1 and kept[None] == 2


def test_decontamination(spark, docs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 200").orderBy("item_id").first()["text"]
    spoiled = docs.withColumn("text", F.when(F.col("doc_id") == 7, F.concat(F.lit("x y "), F.lit(item))).otherwise(F.col("text")))
    kept = Counter(r["doc_id"] for r in STAGES["decontamination"](spark, spoiled, SF).collect())
    assert kept == Counter(r["doc_id"] for r in docs.collect() if r["doc_id"] != 7)


def test_mixing(spark, docs):
    given = docs.drop("size", "taken", "target")
    rows = STAGES["mixing"](spark, given, SF).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
    assert all(0 <= r["taken"] <= 3 * size[r["doc_id"]] for r in rows if r["doc_id"] is not None)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(spark, docs, name):
    given = docs.drop("size", "taken", "target") if name == "mixing" else docs
    assert STAGES[name](spark, given.limit(0), SF).count() == 0
