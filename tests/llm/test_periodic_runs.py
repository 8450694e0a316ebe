import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from demandspark.llm import periodic_runs
from demandspark.llm.periodic_runs import COVER, V, SampledSuffixes


def plain_runs(words, least):
    """Every period by itself, then the smallest of each stretch."""
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i > s and i + p - s >= max(least, 2 * p):
                best.setdefault((s, i + p - s), p)
            i += i == s
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda x: (x[0], x[2]))


def plain_row(doc_id, text, edit):
    words = (text or "").encode().split()
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if edit and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words, 12)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()
    return (doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha(lines),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_cover_reaches_every_difference():
    assert {(b - a) % V for a in COVER for b in COVER} == set(range(V))


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 4), st.integers(0, 300), st.randoms(use_true_random=False), st.sampled_from([2, 4, 12]))
def test_runs_against_every_period(letters, n, rng, least):
    words = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 9)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    got = periodic_runs.runs(np.array(words, np.int32), least)
    assert [tuple(r) for r in got.tolist()] == plain_runs(words, least)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=200), st.integers(1, 60))
def test_common_prefixes(words, p):
    words = np.array((words * 3)[: max(p + 2, len(words))], np.int32)
    n = len(words)
    i, j = (x.ravel() for x in np.triu_indices(n, 1))
    got = SampledSuffixes(words).common(i, j)
    for a, b, k in list(zip(i, j, got, strict=True))[:: max(1, len(i) // 500)]:
        assert (words[a: a + k] == words[b: b + k]).all() and (b + k == n or words[a + k] != words[b + k])


@pytest.mark.parametrize("edit", [None, periodic_runs.planted])
def test_documents(spark, documents, edit):
    passage = "one two three four five six seven "
    more = [(600 + i, t) for i, t in enumerate([passage * 5, "a " * 11, "a " * 12, "x y " * 6, "x y " * 5 + "x", passage + "eight " + passage, "a b " * 20])]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    docs = docs.selectExpr("*", "1 AS n_runs", "2 AS start", "3 AS length", "4 AS period")
    docs = docs.filter("doc_id IS NULL OR doc_id <> 44")  # the very long one: below
    got = Counter(tuple(r) for r in periodic_runs.periodic_runs(docs, edit=edit).collect())
    assert got == Counter(plain_row(r["doc_id"], r["text"], edit) for r in docs.collect())


def test_very_long_texts():
    rng = np.random.RandomState(1)
    base = rng.randint(0, 5000, 90_000).astype(np.int32)
    words = np.concatenate([base[:70_000], base[:70_000], base[70_000:]])
    assert periodic_runs.runs(words).tolist() == [[0, 140_000, 70_000]]
    assert periodic_runs.runs(np.zeros(70_000, np.int32)).tolist() == [[0, 70_000, 1]]


def test_empty_table(no_documents):
    assert periodic_runs.periodic_runs(no_documents).count() == 0
