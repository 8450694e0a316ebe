import random
from collections import Counter

import pandas as pd

from demandspark.llm import near_dup
from demandspark.llm.shared import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def reachable(rows):
    """Smallest id reachable for every row, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return Counter((i, len(s), least.get(root(k)) if s else i) for k, (i, s) in enumerate(sets))


def result(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows if r["doc_id"] is not None)
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)


def test_equals_all_pairs(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert result(near_dup.near_duplicates(documents)) == reachable(rows)


def test_long_lists_are_compared_in_blocks(documents, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 1)
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 4)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert result(near_dup.near_duplicates(documents)) == reachable(rows)


def test_empty_table(no_documents):
    assert near_dup.near_duplicates(no_documents).count() == 0


def test_one_row_of_each_group_stays(documents):
    kept = near_dup.drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = {i for i, _, least in reachable(rows) if i == least and i is not None}
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(ids) == sorted(want)


def test_block_links_join_components():
    import numpy as np

    rng = np.random.default_rng(1)
    one = np.unique(rng.integers(0, 1 << 60, 500))
    two = np.unique(np.concatenate([one[:450], rng.integers(0, 1 << 60, 50)]))
    three = np.unique(rng.integers(0, 1 << 60, 500))
    cell = pd.DataFrame({"node": [b"b", b"a", b"c"], "component": [b"b", b"a", b"c"], "shingles": [two, one, three], "outlier": [True, False, False]})
    assert near_dup._forest(cell).values.tolist() == [[b"b", b"a"]]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (100, 102), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(7)
    path = list(range(100, 140))
    rng.shuffle(path)
    edges = list(zip(path, path[1:], strict=False))
    edges += [(250, n) for n in range(200, 300)] + [(n, 199) for n in range(290, 300)]
    edges += [(301, 302), (302, 303), (303, 301), (400, 400), (302, 301)]
    edges += [(rng.randrange(500, 560), rng.randrange(500, 560)) for _ in range(45)]
    parent = {n: n for e in edges if e[0] != e[1] for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len(parent) and {r.node: r.component for r in found} == {n: root(n) for n in parent}
