"""Mixing sources to target weights, filled to the word.

1. Documents are counted by source and exact length.
2. Sources by name weigh 1, 2, 3, repeating (or as given) and share a budget; no source may
   give more than ``cap`` times its size, and the excess goes to the others by weight.
3. A source takes all its documents as often as the target holds its size. The rest of the
   budget is filled from the length counts: an equal part of every length, the longest
   lengths that fit, and a bounded-knapsack program for the last words.
4. Of each length the wanted number of documents is chosen by a seeded hash.

What step 3 sees of a source is one row a length: bounded by the longest document, not by
the number of documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandspark.llm.shared import stage

CAP = 3
WEIGHTS = (1, 2, 3)
SEED = 17
# budgets up to this are filled by dynamic programming over every word
KNAPSACK = 1 << 14
BUCKET = 1000
_WORD = r"[^\x20\x09-\x0D]+"


def with_targets(sources: DataFrame, share: float = 1.0, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row a source.

    The water level rises until no source is above its cap; only two sums a round reach the
    driver. Sources are numbered by a distributed sort.
    """
    spark = sources.sparkSession
    ranked = sources.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(
        lambda x: (x[0]["source"], x[0]["source_size"], int(weights[x[1] % len(weights)]))
    )
    schema = T.StructType([sources.schema["source"], T.StructField("source_size", T.LongType()), T.StructField("weight", T.LongType())])
    ranked = stage(spark.createDataFrame(ranked, schema), "mix-sources")
    level, capped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap * F.col("source_size")
        total, held, weight, count = ranked.agg(
            F.sum("source_size"), F.sum(F.when(over, cap * F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.sum(over.cast("int"))
        ).first()
        if not total or count == capped or not weight:
            break
        level, capped = (total * share - held) / weight, count
    target = F.least(F.col("weight") * F.lit(float(level or 0.0)), (cap * F.col("source_size")).cast("double"))
    return ranked.withColumn("target", target)


def fill(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come near ``budget``.

    sizes: distinct lengths over 0. Bounded knapsack by binary splitting on a bit set of
    reachable sums; larger budgets are first brought down by equal parts and long lengths.
    """
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = np.floor(counts * (budget / total)).astype(np.int64) if total else np.zeros_like(counts)
    left = budget - int((sizes * taken).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if left <= KNAPSACK:
            break
        more = min(int(counts[i] - taken[i]), (left - KNAPSACK // 2) // int(sizes[i])) if sizes[i] <= left else 0
        more = max(more, 0)
        taken[i] += more
        left -= more * int(sizes[i])
    # only where every length is large is a budget over KNAPSACK left: then in units of several words
    unit = max(1, -(-left // KNAPSACK))
    units, most = -(-sizes // unit), left // unit
    reach, steps, mask = 1, [], (1 << (most + 1)) - 1
    for i in np.argsort(sizes, kind="stable"):
        free, size, power = int(min(counts[i] - taken[i], most // units[i])), int(units[i]), 1
        while free > 0 and not reach >> most & 1:
            n = min(power, free)
            steps.append((i, n, reach))
            reach = (reach | reach << (n * size)) & mask
            free, power = free - n, power * 2
    at = reach.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += n
            at -= n * int(units[i])
    # one document more, if that comes nearer than staying below
    left, free = budget - int((sizes * taken).sum()), np.flatnonzero(taken < counts)
    if left > 0 and len(free) and sizes[free].min() < 2 * left:
        taken[free[np.argmin(sizes[free])]] += 1
    return taken


def _plan(lengths: pd.DataFrame) -> pd.DataFrame:
    """For one source: how often every document is taken, and how many of each length once more."""
    total = int(lengths["source_size"].iloc[0])
    target = float(lengths["target"].iloc[0])
    lengths = lengths.sort_values("size").reset_index(drop=True)
    rounds = min(int(target // total), CAP) if total else 0
    extra = np.zeros(len(lengths), np.int64)
    long = (lengths["size"] > 0).to_numpy()
    extra[long] = fill(lengths["size"].to_numpy()[long], lengths["n"].to_numpy()[long], round(target - rounds * total))
    return lengths.assign(rounds=rounds, extra=extra)[["key", "size", "rounds", "extra"]]


def mix_sources(docs: DataFrame, doc_id="doc_id", text="text", source="source", share: float = 1.0, weights=WEIGHTS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    size: words between ASCII white space, 0 for null and empty texts, which are never
    taken. A null source is a source of its own, the last. Repeated rows are documents of
    their own; of equal (doc_id, source, size) as many are taken as the plan says, whichever.
    Other columns are ignored. Without documents the result is empty.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"))
    draw = F.xxhash64(F.lit(seed), "doc_id", "size")
    # never null, so that joins and groups need no special case
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    rows = stage(rows.withColumn("key", key).withColumn("draw", draw), "mix-documents")
    lengths = stage(rows.groupBy("source", "key", "size").agg(F.sum("copies").alias("n")), "mix-lengths")
    totals = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = stage(with_targets(totals, share, weights).withColumn("key", key).drop("source"), "mix-targets")

    table = lengths.drop("source").join(sources, "key").select("key", "size", "n", "source_size", "target")
    chosen = table.groupBy("key").applyInPandas(_plan, "key string, size long, rounds long, extra long")
    plan = stage(table.join(chosen, ["key", "size"]), "mix-plan")

    # of a length, whole hash buckets are taken up to the one in which the number is reached
    marked = rows.join(plan, ["key", "size"]).withColumn("bucket", F.pmod("draw", F.ceil(F.col("n") / BUCKET)))
    filled = marked.groupBy("key", "size", "bucket").agg(F.sum("copies").alias("held"))
    before = F.sum("held").over(Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    filled = filled.withColumn("before", F.coalesce(before, F.lit(0)))
    placed = marked.join(filled, ["key", "size", "bucket"])
    whole = placed.filter("before + held <= extra OR before >= extra").withColumn("more", F.when(F.col("before") < F.col("extra"), F.col("copies")).otherwise(F.lit(0)))
    order = Window.partitionBy("key", "size").orderBy("draw", "doc_id")
    ahead = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
    cut = placed.filter("before + held > extra AND before < extra").withColumn("ahead", ahead)
    cut = cut.withColumn("more", F.least("copies", F.greatest(F.lit(0), F.col("extra") - F.col("ahead")))).drop("ahead")
    each = whole.unionByName(cut).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    times = F.col("rounds") + F.when(F.col("i") <= F.col("more"), 1).otherwise(0)
    return each.select("doc_id", "source", "size", "source_size", "target", (times * F.col("size")).alias("taken"))

