"""Repeated three-line windows, found globally and cut from all but their first occurrence.

DataFrame functions only. Every text is split at line feeds; each window of three
consecutive lines is hashed to 128 bits; a text of one or two lines is one window, equal
only to another whole text. The first occurrence of a window, by document id,
then text, then line, stays; the lines that any later occurrence covers go. Overlapping
windows merge by themselves, as the covered line numbers of a document form one set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.shared import free_names

LINES = 3


def windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, doc_key, at, h1, h2) of every window; ``at`` is its first line, from 0.

    A text of fewer than three lines is one window; lines of spaces only are none.
    """
    lines = F.split(F.col(text), "\n", -1)
    rows = docs.select(F.col(doc_id).alias("doc_id"), _doc_key(text).alias("doc_key"), lines.alias("x")).filter(F.col(text).isNotNull())
    size = F.size("x")

    def window(i):
        three = [F.get("x", i + j) for j in range(LINES)]  # null after the end of a shorter text
        blank = F.lit(True)
        for line in three:
            blank = blank & (F.coalesce(F.trim(line), F.lit("")) == "")
        # the second hash starts from another seed, the number of lines: hashing passes over nulls
        return F.struct(i.alias("at"), F.xxhash64(*three).alias("h1"), F.xxhash64(F.least(size, F.lit(LINES)), *three).alias("h2"), blank.alias("blank"))

    each = F.explode(F.transform(F.sequence(F.lit(0), F.greatest(size - LINES, F.lit(0))), window)).alias("w")
    return rows.select("doc_id", "doc_key", each).filter("NOT w.blank").select("doc_id", "doc_key", "w.at", "w.h1", "w.h2")


def _doc_key(text: str):
    """Tells documents apart that share an id."""
    return F.xxhash64(F.lit("document"), F.col(text))


def covered_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, doc_key, covered): line numbers that later occurrences cover, of documents with any; those of a short text may pass its end."""
    every = windows(docs, doc_id, text)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc_key", "at")
    # combined before the shuffle, so a passage in a third of all documents is one row a task
    first = every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h1", "h2", "first")
    later = every.join(first, ["h1", "h2"]).filter(place != F.col("first")).select("doc_id", "doc_key", "at")
    return later.groupBy("doc_id", "doc_key").agg(
        F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + LINES - 1)))).alias("covered")
    )


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the covered lines cut from ``text``; every row and other column stays.

    Null texts stay null. Rows that repeat a document, id and text alike, are one document
    given twice: both keep its first occurrences. Documents without an id come last in the
    order. A text all of whose lines are covered becomes empty.
    """
    cut_id, cut_key, gone, own = free_names(docs, "cut_id", "cut_key", "gone", "own_key")
    cut = covered_lines(docs, doc_id, text).select(F.col("doc_id").alias(cut_id), F.col("doc_key").alias(cut_key), F.col("covered").alias(gone))
    marked = docs.withColumn(own, _doc_key(text))
    marked = marked.join(cut, F.col(doc_id).eqNullSafe(F.col(cut_id)) & (F.col(own) == F.col(cut_key)), "left")
    lines = F.split(F.col(text), "\n", -1)
    # a set difference of line numbers: its work grows with the lines, not with their square
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    rest = F.transform(left, lambda i: F.get(lines, i))
    new = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(rest, "\n"))
    return marked.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
