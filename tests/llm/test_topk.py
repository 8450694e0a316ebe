import math
import random

import numpy as np
import pytest

from demandspark.llm import topk


def brute(rows, k):
    clean = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * float(np.float32(x))) for x in v]
        clean[i] = min(clean.get(i, w), w)
    out = []
    for q in clean:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(clean[q], w, strict=True)), i) for i, w in clean.items() if i != q and len(w) == len(clean[q]))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 40])
def test_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(120)]  # ties
    rows += [(600, None), (601, []), (602, [1.0, None] * 4), (603, [float("nan")] * 8), (650, [float("inf")] * 8), (None, rows[0][1])]
    rows += [(700, [1.0, 2.0]), (750, [3.0, 1.0]), (800, [1.0, 2.0, 3.0]), (5, rows[5][1]), (50, rows[50][1]), (50, rows[51][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS cell", "3 AS v", "4 AS dims")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == brute(rows, 5)


def test_large_components(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    rows += [(201, [1e7, 0.0, 0.0, 0.0]), (202, [0.0, -9e6, 0.0, 1.0]), (203, [0.0, 0.0, 8388608.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == brute(rows, 5)


def test_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_cover_tree_covers():
    points = np.random.default_rng(0).normal(size=(900, 5)).round(1)
    root, order = topk.cover_tree(points)
    todo = [root]
    while todo:
        node = todo.pop()
        inside = points[order[node.lo : node.hi]]
        assert topk._distances(inside, node.centre).max() <= node.radius + 1e-9
        assert not node.children or [node.children[0].lo, node.children[-1].hi] == [node.lo, node.hi]
        todo += node.children
