"""Near-duplicate documents from bottom-k sketches.

One hash function maps every five-word shingle to 64 bits. A document's sketch is the
``K`` smallest values; documents with equal shingle sets collapse into one class first.

1. Inverted lists of the retained values yield the candidates. A pair at 75% or more
   shares at least ``c = ceil(0.375 * sketch size)`` retained values (exactly so for sets
   that fit the sketch, else but for a chance of about 1e-10), so it meets in one of the
   ``size - c + 1`` rarest values of each side, and only those are listed. Passages that
   very many documents share are thus no list of a document that has text of its own.
2. The union sketch (the K smallest values of both) estimates the similarity; pairs under
   an estimate of 0.375 go.
3. The rest is confirmed on full shingle sets: ``100 * both >= 75 * either``.

Only reachability is asked for, so the pairs of a large list are not all made: each list
first links its members to its most central one, components merge, and closed lists drop
out. Members of lists longer than ``SMALL`` that are still apart are compared in blocks of
bounded size, inside tasks, which emit a spanning forest of the links they confirm.
Every pair that meets in a list is thus compared or already connected; there is no cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.shared import components, free_names, in_batches, lower_words, stage

WORDS = 5
K = 64
SHARE = 0.375
SMALL = 32
BLOCK_DOCS = 256
BLOCK_SHINGLES = 500_000
SLOTS = 1 << 22
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class WordHashes(dict):
    """64-bit hash by word; forgets everything once it holds ``limit`` words."""

    limit = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text, as signed integers."""
    words = lower_words(text)
    if not words:
        return np.empty(0, np.int64)
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(one) - WORDS + 1)
    out = np.full(n, min(len(one), WORDS), np.uint64)
    for i in range(min(len(one), WORDS)):
        out = _mix(out + one[i : n + i] * _MULTIPLIERS[i])
    return np.unique(out.view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


def _chunks(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _sketch_batches(batches):
    hashes = WordHashes()
    for batch in batches:
        for part in _chunks(batch):
            sets = [shingle_set(t, hashes) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    _lists([s[:K] for s in sets]),
                ],
                names=["doc_id", "n_shingles", "node", "sketch"],
            )


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, node, sketch): node is a digest of the shingle set, null if empty."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return in_batches(rows).mapInArrow(_sketch_batches, "doc_id long, n_shingles long, node binary, sketch array<long>")


def _inverted(classes: DataFrame) -> DataFrame:
    """(value, node, weight): the rarest retained values of each class that others retain too."""
    values = classes.select("node", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("often")).filter("often > 1")
    need = F.greatest(F.lit(1), F.ceil(F.col("k") * SHARE))
    # values of this class alone are its rarest and take the first places
    places = (F.first("k") - F.first(need) + 1) - (F.first("k") - F.count("*"))
    return (
        values.join(often, "value").groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("often", "value"))).alias("v"), places.cast("int").alias("places"), F.sum("often").alias("weight"))
        .filter("places > 0")
        .select("node", "weight", F.explode(F.slice("v", F.lit(1), F.col("places"))).alias("v"))
        .select("v.value", "node", "weight")
    )


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose sizes fit and whose union sketch estimates at least ``SHARE``."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .filter("100 * least(na, nb) >= 75 * greatest(na, nb)")
        .withColumn("u", union)
        .filter(F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u"))) >= F.size("u") * SHARE)
        .select("a", "b")
    )


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .withColumn("both", both)
        .filter(100 * F.col("both") >= 75 * (F.size("sa") + F.size("sb") - F.col("both")))
        .select("a", "b")
    )


def _full_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, shingles) of the classes in ``wanted`` (node, rep), computed again from their texts.

    A bitmap of SLOTS bits, whatever the number of classes, spares the shuffle of texts
    that surely are not wanted; the join by node drops the rest.
    """
    spark = docs.sparkSession
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(SLOTS)).cast("int")
    bits = np.zeros(SLOTS, bool)
    bits[wanted.select(slot("rep").alias("slot")).distinct().toPandas()["slot"].to_numpy()] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    def run(batches):
        hashes, keep = WordHashes(), np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(keep[batch.column("slot").to_numpy()]))
            for part in _chunks(batch):
                sets = [shingle_set(t, hashes) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), _lists(sets)], names=["node", "shingles"]
                )

    rows = docs.select(slot(doc_id).alias("slot"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    found = in_batches(rows).mapInArrow(run, "node binary, shingles array<long>")
    return found.join(wanted.select("node"), "node").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _forest(cell: pd.DataFrame) -> pd.DataFrame:
    """Links between the outliers and the members of one cell that join different components."""
    left, right = cell[cell["outlier"]], cell[~cell["outlier"]]
    if left.empty or right.empty:
        return pd.DataFrame({"a": [], "b": []}, dtype=object)
    parent = {c: c for c in cell["component"]}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    sizes = right["shingles"].map(len).to_numpy()
    values = np.concatenate([*right["shingles"], np.empty(0, np.int64)])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
    nodes, groups = right["node"].tolist(), right["component"].tolist()
    heads = [s[:K] for s in right["shingles"]]
    head_of = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
    head_values = np.concatenate([*heads, np.empty(0, np.int64)])
    found = []
    for node, own, group in zip(left["node"], left["shingles"], left["component"], strict=True):
        head = own[:K]
        shared = np.bincount(head_of[np.isin(head_values, head)], minlength=len(heads))
        fits = 100 * np.minimum(sizes, len(own)) >= 75 * np.maximum(sizes, len(own))
        # the union sketch cannot estimate SHARE if the sketches do not share that part of the smaller one
        fits &= shared >= SHARE * np.minimum(np.minimum(sizes, K), len(head))
        fits &= np.array([root(g) != root(group) for g in groups])
        if not fits.any():
            continue
        at = np.flatnonzero(fits)
        pick = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in at])
        there = np.searchsorted(own, values[pick])
        hit = own[np.minimum(there, len(own) - 1)] == values[pick]
        both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes[at])[:-1]]))
        for i, n in zip(at, both, strict=True):
            if 100 * n >= 75 * (sizes[i] + len(own) - n) and root(groups[i]) != root(group):
                parent[root(groups[i])] = root(group)
                found.append((node, nodes[i]))
    return pd.DataFrame(found, columns=["a", "b"])


def _labelled(lists: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """The members of lists in which more than one component is left, with their component."""
    labels = components(links, name)
    member = lists.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = member.groupBy("value").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    return stage(member.join(open_.select("value", "m"), "value"), name)


def _family_links(long: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of long lists that are still in different components.

    Lists with members in common form a family, so that a pair that meets in many of them
    is compared once. In a family, the members outside its largest component are compared
    with all, in blocks.
    """
    hubs = long.groupBy("value").agg(F.min("node").alias("a"))
    families = components(long.join(hubs, "value").select("a", F.col("node").alias("b")), "families")
    member = stage(
        long.select("node", "component").distinct().join(families.withColumnRenamed("component", "family"), "node").join(sets, "node"), "family-members"
    )
    size = F.greatest(F.count("*") / BLOCK_DOCS, F.sum(F.size("shingles")) / BLOCK_SHINGLES)
    blocks = lambda df, c: df.groupBy("family").agg(F.ceil(size).cast("int").alias(c))
    main = member.groupBy("family", "component").count().groupBy("family").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    marked = member.join(main, "family").withColumn("outlier", F.col("component") != F.col("main"))
    number = stage(blocks(member, "n_all").join(blocks(marked.filter("outlier"), "n_out"), "family"), "family-blocks")
    marked = marked.join(number, "family")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["family", "i", "j", "node", "component", "shingles"]
    out = marked.filter("outlier").withColumn("i", part("n_out")).withColumn("j", every("n_all")).select(*columns, F.lit(True).alias("outlier"))
    rest = marked.withColumn("i", every("n_out")).withColumn("j", part("n_all")).select(*columns, F.lit(False).alias("outlier"))
    # dealt by cell: the joins above leave rows dealt by family, which would do for the grouping
    # and bring all cells of a family to one task
    cells = out.unionByName(rest).repartition("family", "i", "j").groupBy("family", "i", "j")
    return cells.applyInPandas(_forest, "a binary, b binary")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Other columns are ignored whatever their names. Null and empty texts have no shingles
    and stand alone. Rows with the same shingle set are linked, repeated rows too; each
    repeated row is returned. A row without an id takes part in the links, but no component
    is named by it unless all its ids are null. No rows give no rows.
    """
    rows = stage(sketches(docs, doc_id, text), "sketches")
    classes = stage(
        rows.filter("node IS NOT NULL").groupBy("node")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")),
        "classes",
    )
    inverted = stage(_inverted(classes), "inverted")
    hubs = inverted.groupBy("value").agg(F.count("*").alias("m"), F.max_by("node", F.struct("weight", "node")).alias("hub")).filter("m > 1")
    lists = stage(inverted.join(hubs, "value").select("value", "node", "hub"), "lists")
    wanted = lists.select("node").distinct().join(classes.select("node", "rep"), "node")
    sets = stage(_full_sets(docs, stage(wanted, "wanted"), doc_id, text), "sets")

    stars = lists.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = stage(_confirmed(_estimated(stars, classes), sets), "star-links")

    members = lists.select("value", "node")
    left = _labelled(members, links, "open-lists")
    more = _family_links(left.filter(F.col("m") > SMALL), sets)
    links = stage(links.unionByName(more), "family-links")

    left = _labelled(members, links, "small-lists").filter(F.col("m") <= SMALL)
    other = left.select("value", F.col("node").alias("b"), F.col("component").alias("component_b"))
    pairs = left.withColumnRenamed("node", "a").join(other, "value").filter("a < b AND component <> component_b").select("a", "b").distinct()
    links = links.unionByName(_confirmed(_estimated(pairs, classes), sets))

    labels = components(links, "near-duplicates")
    named = classes.select("node", "rep").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    ids = named.join(least, "component").select("node", "least")
    component_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return (
        rows.select("doc_id", "n_shingles", "node").join(ids, "node", "left")
        .select("doc_id", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"))
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, with all columns: the one with the smallest doc_id.

    Rows that repeat a kept row's id and text go too; documents without words stay. Rows without
    an id stay if one of them does.
    """
    kept_id, often_id = free_names(docs, "kept_id", "often_id")
    found = near_duplicates(docs, doc_id, text)
    kept = found.filter("kept").select(F.col("doc_id").alias(kept_id)).distinct()
    own = docs.join(kept, F.col(doc_id).cast("long").eqNullSafe(F.col(kept_id)), "left_semi")
    often = found.filter("kept").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(often_id))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(often_id))
    once = own.join(often, same, "left_anti")
    return once.unionByName(own.join(often, same, "left_semi").dropDuplicates([doc_id, text]))
