"""Exact top-k inner products by a dual-tree search over cover trees.

Vectors become whole numbers, floor(256 x). They are grouped around centres of a bounded
sample (the top of the tree) and cut into blocks of about ``BLOCK`` vectors; every block is
the root of a cover tree. Queries and data are indexed alike. For a pair of nodes with
centres c, d and covering radii r, s no inner product exceeds
``c.d + r|d| + s|c| + r s``; a pair whose bound is below the worst k-th score of the
node's queries is left out, first for whole blocks, then inside the trees.

Inner products are exact in float64 while their terms add up to less than 2**53 in
absolute value: with 64 dimensions, for components up to 46,340. Scores of 2**63 and more
have no bigint.

Blocks, not rows, are joined: each query block meets the data blocks its bound cannot rule
out. Only the sample, bounded by ``SAMPLE``, and the centres reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandspark.llm.shared import stage

SCALE = 256
BLOCK = 8192
SAMPLE = 2048
CENTRES = 64
LEAF = 64
FAN = 16
SHRINK = 1.3


class Node:
    """A cover-tree node: its points are rows[lo:hi], none further than ``radius`` from ``centre``."""

    __slots__ = ("lo", "hi", "centre", "radius", "norm", "children")

    def __init__(self, lo: int, hi: int, centre: np.ndarray, radius: float):
        self.lo, self.hi, self.centre, self.radius, self.children = lo, hi, centre, radius, []
        self.norm = float(np.sqrt(centre @ centre))


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = points - centre
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def cover_tree(points: np.ndarray) -> tuple[Node, np.ndarray]:
    """The tree of ``points`` and the order in which its nodes hold them.

    The children of a node are a net of its points: each next centre is the point furthest
    from those chosen, until all lie within radius / SHRINK of one or FAN are chosen. So
    centres are separated, and points are covered by the child they are nearest to.
    """
    order = np.arange(len(points))
    root = Node(0, len(points), points[0], float(_distances(points, points[0]).max()))
    todo = [root]
    while todo:
        node = todo.pop()
        if node.hi - node.lo <= LEAF or node.radius == 0:
            continue
        rows = order[node.lo : node.hi]
        mine = points[rows]
        near = _distances(mine, node.centre)
        # the node's own centre may have gone to a parent's other child
        first = int(np.argmin(near))
        near, of, chosen = _distances(mine, mine[first]), np.zeros(len(rows), int), [first]
        while near.max() > node.radius / SHRINK and len(chosen) < FAN:
            far = int(np.argmax(near))
            d = _distances(mine, mine[far])
            of[d < near] = len(chosen)
            near = np.minimum(near, d)
            chosen.append(far)
        if len(chosen) == 1:
            # the net has one member: split off the points furthest from it
            if near.max() == 0:
                node.radius, node.centre = 0.0, mine[first]
                continue
            far = int(np.argmax(near))
            d = _distances(mine, mine[far])
            of[d < near] = 1
            near = np.minimum(near, d)
            chosen.append(far)
        order[node.lo : node.hi] = rows[np.argsort(of, kind="stable")]
        lo = node.lo
        for i, at in enumerate(chosen):
            inside = of == i
            child = Node(lo, lo + int(inside.sum()), mine[at], float(near[inside].max()))
            lo = child.hi
            node.children.append(child)
            todo.append(child)
    return root, order


def bound(a: Node, b: Node) -> float:
    """No inner product of a point of ``a`` and one of ``b`` is larger."""
    most = float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
    return most + 1e-9 * abs(most) + 1e-6


class Best:
    """The k best candidates of every query: higher score first, then smaller id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.ids = queries
        self.k = k
        self.score = np.full((len(queries), k), -np.inf)
        self.found = np.zeros((len(queries), k), np.int64)

    def worst(self, lo: int, hi: int) -> float:
        return float(self.score[lo:hi, -1].min())

    def offer(self, lo: int, hi: int, ids: np.ndarray, score: np.ndarray) -> None:
        score = np.where(self.ids[lo:hi, None] == ids[None], -np.inf, score)
        for i in np.flatnonzero((score >= self.score[lo:hi, -1:]).any(1) & (score > -np.inf).any(1)):
            at = np.flatnonzero((score[i] >= self.score[lo + i, -1]) & (score[i] > -np.inf))
            s = np.concatenate([self.score[lo + i], score[i, at]])
            f = np.concatenate([self.found[lo + i], ids[at]])
            keep = np.lexsort((f, -s))[: self.k]
            self.score[lo + i], self.found[lo + i] = s[keep], f[keep]


def dual_search(q_ids, q_points, d_ids, d_points, k: int) -> Best:
    """Best of the data for the queries; both are indexed, and pairs of nodes pruned."""
    q_root, q_order = cover_tree(q_points)
    d_root, d_order = cover_tree(d_points)
    q_points, d_points = q_points[q_order], d_points[d_order]
    best, d_ids = Best(q_ids[q_order], k), d_ids[d_order]
    stack = [(bound(q_root, d_root), q_root, d_root)]
    while stack:
        most, q, d = stack.pop()
        if most < best.worst(q.lo, q.hi):
            continue
        if not q.children and not d.children:
            # a node of equal points has no children however many they are
            for at in range(d.lo, d.hi, 4096):
                to = min(at + 4096, d.hi)
                for lo in range(q.lo, q.hi, 1024):
                    hi = min(lo + 1024, q.hi)
                    best.offer(lo, hi, d_ids[at:to], q_points[lo:hi] @ d_points[at:to].T)
            continue
        # open the wider node; the most promising pairs are searched first
        if q.children and (not d.children or q.radius >= d.radius):
            pairs = [(bound(c, d), c, d) for c in q.children]
        else:
            pairs = [(bound(q, c), q, c) for c in d.children]
        stack.extend(sorted(pairs, key=lambda p: p[0]))
    return best


def _centres(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` points of the sample, each the furthest from those before it."""
    chosen = [0]
    near = _distances(points, points[0])
    while len(chosen) < min(n, len(points)) and near.max() > 0:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, _distances(points, points[chosen[-1]]))
    return points[chosen]


def _whole(column: str):
    """floor(256 x) of each component; null for null vectors, components that are null or not finite, and empty ones."""
    limit = float("inf")
    ok = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < limit))
    return F.when(ok & (F.size(column) > 0), F.transform(column, lambda x: F.floor(x.cast("double") * SCALE)))


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """(block, dims, n, ids, points, centre, radius): rows (vec_id, v, cell) in blocks of about BLOCK."""
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    salted = rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("vec_id")
        points = np.stack(block["v"].to_numpy()).astype(float)
        centre = points.mean(0)
        # half the space, where all components fit
        kind = np.int32 if np.abs(points).max() < 2**31 else np.int64
        return pd.DataFrame({
            "dims": [points.shape[1]], "ids": [block["vec_id"].to_numpy(np.int64).tobytes()], "points": [points.astype(kind).tobytes()],
            "centre": [centre], "radius": [float(_distances(points, centre).max())],
        })

    packed = salted.groupBy("cell", "part").applyInPandas(pack, "dims int, ids binary, points binary, centre array<double>, radius double")
    return stage(packed.withColumn("block", F.monotonically_increasing_id()), name)


def _unpacked(points: bytes, n: int, dims: int) -> np.ndarray:
    kind = np.int32 if len(points) == 4 * n * dims else np.int64
    return np.frombuffer(points, kind).reshape(n, dims).astype(float)


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query in each pair of blocks."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, d_ids = (np.frombuffer(row[f"{x}_ids"], np.int64) for x in "qd")
                q, d = (_unpacked(row[f"{x}_points"], len(ids), row["dims"]) for x, ids in (("q", q_ids), ("d", d_ids)))
                best = dual_search(q_ids, q, d_ids, d, k)
                there = np.isfinite(best.score)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(best.ids, k)[there.ravel()]), pa.array(best.found[there]), pa.array(best.score[there].astype(np.int64))],
                    names=["query_id", "vec_id", "score"],
                )

    columns = ["dims", "q_ids", "q_points", "d_ids", "d_points"]
    found = pairs.select(*columns).mapInArrow(run, "query_id long, vec_id long, score long")
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows with the highest integer inner product.

    Queries are the rows whose id is divisible by ``every``; candidates all rows but those
    with the query's id, of as many dimensions. Ties go to the smaller id. Rows with a null
    id take no part, nor do null or empty vectors or such with a component that is null or
    not finite. Of rows that repeat an id, the least vector counts. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), _whole(vector).alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = stage(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    n = rows.count()
    # one centre a block, of a bounded sample; vectors of other lengths are a cell of their own
    sample = rows.orderBy(F.xxhash64(F.lit("centre"), "vec_id")).limit(SAMPLE).toPandas()
    by_dims: dict[int, np.ndarray] = {}
    for dims, part in sample.groupby(sample["v"].map(len)):
        by_dims[int(dims)] = _centres(np.stack(part["v"].to_numpy()).astype(float), min(CENTRES, -(-n // BLOCK)))
    shared = spark.sparkContext.broadcast(by_dims)

    def place(batches):
        for batch in batches:
            cells = []
            for v in batch.column("v").to_pylist():
                centres = shared.value.get(len(v))
                cells.append(f"{len(v)}:{0 if centres is None else int(np.argmin(_distances(centres, np.array(v, float))))}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=["vec_id", "v", "cell"])

    placed = stage(rows.mapInArrow(place, "vec_id long, v array<bigint>, cell string"), "vectors-placed")
    data = _blocks(placed, "data-blocks")
    queries = _blocks(placed.filter(F.col("vec_id") % every == 0), "query-blocks")

    dot = F.aggregate(F.arrays_zip("qc", "dc"), F.lit(0.0), lambda s, x: s + x["qc"] * x["dc"])
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    heads = lambda df, x: df.select(F.col("block").alias(f"{x}_block"), "dims", F.col("centre").alias(f"{x}c"), F.col("radius").alias(f"{x}r"))
    limit = dot + F.col("qr") * norm("dc") + F.col("dr") * norm("qc") + F.col("qr") * F.col("dr") + 1.0
    met = stage(heads(queries, "q").join(heads(data, "d"), "dims").select("q_block", "d_block", "dims", limit.alias("most")), "block-pairs")
    order = Window.partitionBy("q_block").orderBy(F.desc("most"), "d_block")
    nth = met.withColumn("nth", F.row_number().over(order))

    side = lambda df, x: df.select(F.col("block").alias(f"{x}_block"), F.col("ids").alias(f"{x}_ids"), F.col("points").alias(f"{x}_points"))
    full = lambda pairs: pairs.join(side(queries, "q"), "q_block").join(side(data, "d"), "d_block")
    first = stage(_search(full(nth.filter("nth = 1")), k), "first-blocks")
    # the worst k-th score of a query block; unknown until all its queries have k candidates
    worst = _worst(queries, first, k)
    open_ = nth.filter("nth > 1").join(worst, "q_block", "left").filter("worst IS NULL OR most >= worst")
    return _ranked(first.select("query_id", "vec_id", "score").unionByName(_search(full(open_), k).select("query_id", "vec_id", "score")), k)


def _worst(queries: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """(q_block, worst): the lowest k-th score so far of the queries of a block, if all have one."""

    def members(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["block"])), pa.array(ids)], names=["q_block", "query_id"])

    listed = queries.select("block", "ids").mapInArrow(members, "q_block long, query_id long")
    last = first.filter(F.col("rank") == k).select("query_id", "score")
    worst = F.when(F.count("score") == F.count("*"), F.min("score")).alias("worst")
    return listed.join(last, "query_id", "left").groupBy("q_block").agg(worst)
