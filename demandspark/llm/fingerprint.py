"""Bottom-k sketches of word shingles, in Spark functions only.

One hash maps every five-word shingle of a text to 64 bits; the sketch is the ``K`` smallest
distinct values, ascending. Sketches of parts merge into that of the whole, and two of them
give estimates of resemblance, containment and the number of distinct shingles. A sketch
with fewer than K values holds all shingles, and what follows from it is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandspark.llm.shared import free_names

WORDS = 5
K = 256
# ids are put in order in groups of so many bits
BITS = 12
_SPAN = float(1 << 64)


def with_sketch(df: DataFrame, text: str, name: str, words: int = WORDS, k: int = K) -> DataFrame:
    """Adds ``name``, the sketch of column ``text`` (array<bigint>).

    Words are runs of characters other than ASCII white space, lower-cased. A text of
    fewer words than a shingle has one shingle, all of it; one without words, or null, has an
    empty sketch.
    """
    parts, hashes, joined, part = free_names(df, "words", "hashes", "joined", "part")
    cut = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[ \\t-\\r]+", -1)
    df = df.withColumn(parts, F.array_remove(cut, ""))
    df = df.withColumn(hashes, F.transform(parts, lambda w: F.xxhash64(w)))
    # hashes of 1, 2, 4, ... words from those of half as many, then what is missing to a shingle
    n, at, size = F.size(hashes), F.col(hashes), 1
    count = F.greatest(n - words + 1, F.lit(0))
    both = lambda a, i, b, j, m: F.zip_with(F.slice(a, i + 1, m), F.slice(b, j + 1, m), lambda x, y: F.xxhash64(x, y))
    df = df.withColumn(joined, at)
    while 2 * size <= words:
        df = df.withColumn(joined, both(F.col(joined), 0, F.col(joined), size, F.greatest(n - 2 * size + 1, F.lit(0))))
        size *= 2
    rest = F.col(joined)
    for i in range(size, words):
        rest = both(rest, 0, at, i, count)
    all_of_it = F.when(n > 0, F.array(F.xxhash64(at))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(part, F.when(n >= words, rest).otherwise(all_of_it))
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct(part)), 1, k)).drop(parts, hashes, joined, part)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(sketches: DataFrame, keys: Sequence[str], sketch: str, k: int = K, salts: int = 64) -> DataFrame:
    """(keys, sketch) of all rows of a key. No key is gathered: k values of each of ``salts`` parts meet."""
    value, salt, place = free_names(sketches, "value", "salt", "place")
    values = sketches.select(*keys, F.explode_outer(sketch).alias(value)).withColumn(salt, F.pmod(F.xxhash64(value), F.lit(salts)))
    # equal values meet in one part, so the parts hold different ones
    values = values.groupBy(*keys, salt, value).agg(F.lit(1).alias(place)).drop(place)
    for by in ([*keys, salt], [*keys]):
        ordered = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
        values = values.withColumn(place, F.row_number().over(ordered)).filter(F.col(place) <= k).drop(place)
    return values.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias(sketch))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact under k."""
    place = (F.element_at(a, k).cast("double") + _SPAN / 2) / _SPAN
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of two texts, 0 to 1; two texts without words are alike."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; all of them if a has none."""
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def as_string(a: Column) -> Column:
    """The values in 16 hexadecimal digits each."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def following(ids: DataFrame, name: str) -> DataFrame:
    """(id, next): the next larger of the distinct ids in integer column ``name``; the largest gets the smallest.

    Null ids are left out. Ids are ordered in groups that share all but their last BITS bits,
    then the groups by the next BITS bits, and so on: no window has over 2^BITS rows,
    however the ids are spread.
    """
    least = ids.agg(F.min(name).alias("a"), F.max(name).alias("b")).first()
    found = ids.filter(F.col(name).isNotNull()).select(F.col(name).cast("long").alias("id")).distinct()
    if least["a"] is None:
        return found.select("id", F.col("id").alias("next"))
    levels, span = 1, int(least["b"]) - int(least["a"])
    while span >> (BITS * levels):
        levels += 1
    # each level: (at, first id, group of the next level, next id in the group)
    level, tables = found.select(F.col("id").alias("at"), "id"), []
    for _ in range(levels):
        # on the top level at most 2^BITS + 2 groups are left; they meet, whatever their signs
        group = F.shiftright("at", BITS) if len(tables) < levels - 1 else F.lit(0).cast("long")
        ordered = Window.partitionBy("group").orderBy("at")
        tables.append(level.withColumn("group", group).withColumn("next", F.lead("id").over(ordered)))
        level = level.groupBy(group.alias("at")).agg(F.min("id").alias("id"))
    first = int(least["a"])
    above = None
    for table in reversed(tables):
        if above is not None:
            table = table.join(above, "group", "left").withColumn("next", F.coalesce("next", "after"))
        above = table.select(F.col("at").alias("group"), F.col("next").alias("after"), "id")
        resolved, above = above, above.drop("id")
    return resolved.select("id", F.coalesce("after", F.lit(first)).alias("next"))


def fingerprints_beside_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, k: int = K) -> DataFrame:
    """Fingerprints of texts, of their edited texts, and of the documents that follow.

    (doc_id, n_chars, edited, sketch, edited_sketch, next_sketch) for every row of ``docs``.
    The edited text has the last quarter of its characters (rounded down) replaced by the first
    as many (or all) of the next document, in ascending order of the integer ids; after the
    last comes the first. Of rows that share an id, the one with the least hash of its text is the
    next document. A row without an id has no next: it is not edited, and its next_sketch is
    null. Null texts count as empty. Other columns are ignored.

    Texts are shuffled once by id; what travels further is a next document's needed
    beginning and its sketch.
    """
    # an alias that changes nothing would keep Spark from reading one exchange twice
    own_id = F.col(doc_id) if doc_id == "doc_id" else F.col(doc_id).alias("doc_id")
    base = docs.select(own_id, F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = base.filter("doc_id IS NOT NULL")
    quarter = F.floor(F.length("text") / 4).cast("int")
    order = following(placed, "doc_id")
    wanted = placed.groupBy("doc_id").agg(F.max(quarter).alias("most"))
    wanted = wanted.join(order, wanted["doc_id"] == order["id"]).select(F.col("doc_id").alias("before"), F.col("next").alias("at"), "most")
    # both joins read the same exchange of (doc_id, text); sketches are made after it
    begun = placed.join(wanted, F.col("doc_id") == F.col("at")).select("before", "text", F.expr("substring(text, 1, most)").alias("head"))
    begun = with_sketch(begun, "text", "next_sketch", words, k).select(
        "before", F.struct(F.xxhash64("text").alias("digest"), "head", "next_sketch").alias("found"))
    begun = begun.groupBy("before").agg(F.min("found").alias("found"))
    both = placed.join(begun, F.col("doc_id") == F.col("before")).withColumn("m", quarter)
    edited = both.select(
        "doc_id", "text", F.length("text").cast("long").alias("n_chars"),
        F.concat(F.expr("substring(text, 1, length(text) - m)"), F.expr("substring(found.head, 1, m)")).alias("edited"),
        F.col("found.next_sketch").alias("next_sketch"))
    alone = base.filter("doc_id IS NULL").select(
        "doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.col("text").alias("edited"),
        F.lit(None).cast("array<bigint>").alias("next_sketch"))
    every = with_sketch(edited.unionByName(alone), "text", "sketch", words, k)
    return with_sketch(every, "edited", "edited_sketch", words, k).drop("text")

