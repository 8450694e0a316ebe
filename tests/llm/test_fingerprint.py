import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandspark.llm import fingerprint
from demandspark.llm.queries import QUERIES

def shingles(text):
    words = [w for w in re.split("[ \t-\r]+", (text or "").lower()) if w]
    return {tuple(words[i: i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("ids", [
    [5], [0, 1, 2], list(range(3, 9000, 7)), [-5, 10**15, 3, -(2**62), 2**62], [4096 * i for i in range(50)] + [4095, 4097],
])
def test_following(spark, ids):
    rows = [(i,) for i in ids] + [(ids[0],), (None,)]
    got = dict(map(tuple, fingerprint.following(spark.createDataFrame(rows, "doc_id long"), "doc_id").collect()))
    ordered = sorted(set(ids))
    assert got == dict(zip(ordered, ordered[1:] + ordered[:1], strict=True))


def test_following_without_ids(spark):
    assert fingerprint.following(spark.createDataFrame([(None,)], "doc_id long"), "doc_id").count() == 0


def test_documents(spark, documents):
    """Small sets are exact: edits, neighbours and estimates against plain sets."""
    docs = documents.withColumn("words", F.lit(1)).withColumn("hashes", F.lit(2)).withColumn("sketch", F.lit(3)).withColumn("text", F.when(F.col("doc_id") == 44, F.expr("substring(text, 1, 900)")).otherwise(F.col("text")))
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    least = {}
    for id_, text in rows:
        if id_ is not None:
            least[id_] = min(least.get(id_, text), text, key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    ordered = sorted(least)
    after = dict(zip(ordered, ordered[1:] + ordered[:1], strict=True))
    likeness = lambda a, b: fingerprint.resemblance(F.col(a), F.col(b))
    found = fingerprint.fingerprints_beside_next(docs, k=1000)
    got = sorted(tuple(r) for r in found.select(
        F.coalesce("doc_id", F.lit(-1)), "n_chars", "edited", F.size("sketch"), F.round(likeness("sketch", "edited_sketch"), 9),
        F.coalesce(F.round(likeness("sketch", "next_sketch"), 9), F.lit(-1.0))).collect())
    want = []
    for id_, text in rows:
        if id_ is None:
            want.append((-1, len(text), text, len(shingles(text)), 1.0, -1.0))
            continue
        beside, m = least[after[id_]], len(text) // 4
        edited = text[: len(text) - m] + beside[:m]
        want.append((id_, len(text), edited, len(shingles(text)), round(share(shingles(text), shingles(edited)), 9), round(share(shingles(text), shingles(beside)), 9)))
    assert got == sorted(want)


@pytest.fixture(scope="module")
def pairs(spark, words):
    rng, rows = random.Random(8), []
    for i in range(120):
        text = [rng.choice(words) for _ in range(2500)]
        other = list(text)
        for _ in range(rng.randrange(400)):
            other[rng.randrange(len(other))] = rng.choice(words)
        rows.append((i, " ".join(text), " ".join(other[: rng.randint(300, 2500)])))
    return rows, spark.createDataFrame(rows, "i long, a string, b string")


def test_estimates_are_near(pairs):
    rows, df = pairs
    for name in "ab":
        df = fingerprint.with_sketch(df, name, f"s{name}")
    a, b = F.col("sa"), F.col("sb")
    got = {r["i"]: r for r in df.select("i", fingerprint.resemblance(a, b).alias("r"), fingerprint.containment(b, a).alias("c"), fingerprint.distinct_shingles(a).alias("n")).collect()}
    errors = {"r": [], "c": [], "n": []}
    for i, x, y in rows:
        sx, sy = shingles(x), shingles(y)
        errors["r"].append(got[i]["r"] - share(sx, sy))
        errors["c"].append(got[i]["c"] - len(sx & sy) / len(sy))
        errors["n"].append(got[i]["n"] / len(sx) - 1)
    # a standard error is at most 1 / (2 sqrt(256)) for shares and 1 / sqrt(254) for counts
    assert np.std(errors["r"]) < 0.04 and np.std(errors["c"]) < 0.09 and np.std(errors["n"]) < 0.08
    assert all(abs(np.mean(e)) < 0.02 for e in errors.values())


def test_parts_merge_into_the_whole(spark, pairs):
    rows, _ = pairs
    parts = [(i % 3, x) for i, x, _ in rows] + [(7, ""), (None, rows[0][1]), (None, None)]
    df = fingerprint.with_sketch(spark.createDataFrame(parts, "g long, text string"), "text", "s")
    got = {r["g"]: r["s"] for r in fingerprint.merge_parts(df, ["g"], "s").collect()}
    values = {}
    for r in df.collect():
        values[r["g"]] = values.get(r["g"], set()) | set(r["s"])
    assert got == {g: sorted(v)[: fingerprint.K] for g, v in values.items()}
    two = df.filter("g < 2").groupBy().pivot("g", [0, 1]).agg(F.first("s"))
    merged = two.select(fingerprint.merge(F.col("0"), F.col("1"))).first()[0]
    first = two.first()
    assert merged == sorted(set(first[0]) | set(first[1]))[: fingerprint.K]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in QUERIES["op12_fingerprints"](spark, sf).collect()}
    assert len(got) == len(docs)
    prints = {}
    for (id_, text), (_, beside) in zip(docs, docs[1:] + docs[:1], strict=True):
        edited, r = text[: len(text) - len(text) // 4] + beside[: len(text) // 4], got[id_]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - share(shingles(text), shingles(edited))) < 0.12
        assert abs(r["near_next"] - share(shingles(text), shingles(beside))) < 0.12
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]


def test_empty_table(no_documents):
    assert fingerprint.fingerprints_beside_next(no_documents).count() == 0
