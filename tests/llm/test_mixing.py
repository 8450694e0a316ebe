from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from demandspark.llm import mixing


def targets(sizes):
    """Water filling over sources in order of name, null last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, free, target = sum(sizes.values()), set(names), {}
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
        free -= over


def test_targets_and_taken(documents):
    rows = documents.collect()
    got = mixing.mix_sources(documents).collect()
    size = lambda t: len((t or "").encode().split())
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r["doc_id"], r["source"], size(r["text"])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += size(r["text"])
    want, taken = targets(sizes), defaultdict(int)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    for s in sizes:
        longest = max(size(r["text"]) for r in rows if r["source"] == s)
        assert abs(taken[s] - want[s]) <= longest / 2 + 1
    again = mixing.mix_sources(documents.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_empty_table_and_empty_texts(no_documents, spark):
    assert mixing.mix_sources(no_documents).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix_sources(empty).collect()] == [(0, 0.0, 0)] * 2


def best_sum(sizes, counts, budget):
    reach = {0}
    for s, n in zip(sizes, counts, strict=True):
        reach |= {r + i * s for r in reach for i in range(1, n + 1) if r + i * s <= budget}
    return max(reach)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), min_size=1, max_size=6), st.integers(0, 300))
def test_fill_is_within_counts_and_near_the_budget(lengths, budget):
    sizes, counts = np.array(sorted(lengths)), np.array([lengths[s] for s in sorted(lengths)])
    taken = mixing.fill(sizes, counts, budget)
    assert (taken >= 0).all() and (taken <= counts).all()
    # equal parts come first, so the whole optimum may be missed by less than the longest document
    best = budget - best_sum(sizes.tolist(), counts.tolist(), budget)
    assert abs(budget - (sizes * taken).sum()) <= best + sizes.max()


def test_fill_of_long_documents():
    sizes, counts = np.array([17_000, 90_000, 2_000_000]), np.array([3, 50, 4])
    taken = mixing.fill(sizes, counts, 1_234_567)
    assert abs(1_234_567 - (sizes * taken).sum()) <= 45_000
