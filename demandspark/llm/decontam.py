"""Benchmark decontamination: test n-grams in a broadcast hash set, scanned over all texts.

Words are runs of 0-9, a-z (A-Z lower-cased) and any non-ASCII character. A window is ten
consecutive words of a benchmark item; an item of fewer words is one window. Words become
numbers of the benchmark vocabulary, so a document window can only hit where ten known
words follow one another; there its hash is looked up and its words compared.

The windows are broadcast in chunks of at most ``CHUNK_WORDS`` item words, cut between
items: one pass over the texts for each chunk, usually the only one. A benchmark of any
size is thus scanned whole with a broadcast of bounded size. Hits of several chunks meet
by document, as intervals.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.shared import free_names, in_batches, stage

WINDOW = 10
CHUNK_WORDS = 1_000_000
_WORD_BYTES = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def benchmark_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_WORD_BYTES).split() if text else []


def _hashes(ids: np.ndarray, length: int) -> np.ndarray:
    n = len(ids) - length + 1
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out = (out ^ ids[i : n + i].astype(np.uint64)) * _FACTOR
        out ^= out >> np.uint64(29)
    return out


class Windows:
    """The windows of one chunk of items: vocabulary, hashes by length, words and items by window."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for name, words in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words)
            length = min(WINDOW, len(ids))
            for i in range(len(ids) - length + 1):
                self.items[ids[i : i + length]].add(name)
        by_length = defaultdict(list)
        for window in self.items:
            by_length[len(window)].append(window)
        self.hashes = {n: np.unique(np.concatenate([_hashes(np.array(w), n) for w in ws])) for n, ws in sorted(by_length.items())}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged intervals (from, to) of hit words, and the items with an occurring window."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        spans, items = [], set()
        for length, known in self.hashes.items():
            if len(ids) < length:
                continue
            gaps = np.concatenate([[0], np.cumsum(ids == 0)])
            at = np.flatnonzero(gaps[length:] == gaps[:-length])
            if not len(at):
                continue
            value = _hashes(ids, length)[at]
            slot = np.minimum(np.searchsorted(known, value), len(known) - 1)
            for i in at[known[slot] == value].tolist():
                names = self.items.get(tuple(ids[i : i + length].tolist()))
                if names:
                    spans.append((i, i + length))
                    items |= names
        return merged(spans), items


def merged(spans) -> list[tuple[int, int]]:
    """Overlapping or touching intervals as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _chunks(benchmark: DataFrame, item_id: str, text: str):
    """Lists of (item_id, words) of at most CHUNK_WORDS words, or of one item that is longer."""
    chunk, size = [], 0
    rows = benchmark.select(F.col(item_id).cast("string"), text).filter(f"`{item_id}` IS NOT NULL AND `{text}` IS NOT NULL")
    for name, value in rows.toLocalIterator():
        words = benchmark_words(value)
        if chunk and size + len(words) > CHUNK_WORDS:
            yield chunk
            chunk, size = [], 0
        if words:
            chunk.append((name, words))
            size += len(words)
    yield chunk


_SCHEMA = "n_words long, spans array<struct<a:int,b:int>>, items array<string>"
_TYPES = {
    "n_words": pa.int64(),
    "spans": pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])),
    "items": pa.list_(pa.string()),
}


def _scanned(rows: DataFrame, text: str, windows: Windows) -> DataFrame:
    """``rows`` with n_words, spans and items of one chunk of windows."""
    shared = rows.sparkSession.sparkContext.broadcast(windows)

    def run(batches):
        found = shared.value
        for batch in batches:
            got = []
            for value in batch.column(text):
                words = benchmark_words(value.as_py())
                spans, items = found.scan(words)
                got.append((len(words), [{"a": a, "b": b} for a, b in spans], sorted(items)))
            new = [pa.array([g[i] for g in got], kind) for i, kind in enumerate(_TYPES.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *_TYPES])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return in_batches(rows).mapInArrow(run, f"{fields}, {_SCHEMA}")


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text") -> DataFrame:
    """(doc_id, n_words, spans, items) for every row: hit word intervals and item_ids as strings.

    Null and empty texts have no words. Items without id, text or words have no windows.
    Repeated documents each give a row, repeated items count once. Without items nothing
    is hit. Other columns are ignored.
    """
    chunks = _chunks(benchmark, item_id, item_text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    first, second = next(chunks), next(chunks, None)
    if second is None:
        return _scanned(rows, "text", Windows(first)).drop("text")
    keyed = stage(rows.withColumn("row", F.monotonically_increasing_id()), "decontam-rows")
    found = _hits(keyed, itertools.chain([first, second], chunks)).drop("n_words")
    counted = _scanned(keyed, "text", Windows([])).select("row", "doc_id", "n_words")
    return counted.join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text="text", item_id="item_id", item_text="text", max_share: float = 0.0) -> DataFrame:
    """The rows of ``docs`` of whose words at most ``max_share`` are hit, with all columns as they are.

    Hits are those of the whole benchmark, however many chunks it is cut into. Texts without
    words stay; so do columns of any name, and repeated rows as often as they come.
    """
    chunks = _chunks(benchmark, item_id, item_text)
    first, second = next(chunks), next(chunks, None)
    if second is None:
        return _kept(docs, text, Windows(first), max_share)
    (row,) = free_names(docs, "row")
    keyed = stage(docs.withColumn(row, F.monotonically_increasing_id()), "decontam-rows")
    given = keyed.select(F.col(row).alias("row"), F.col(text).alias("text"))
    counted = _hits(given, itertools.chain([first, second], chunks))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["b"] - s["a"]))
    dirty = counted.filter(hit > F.lit(float(max_share)) * F.col("n_words")).select(F.col("row").alias(row))
    return keyed.join(dirty, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _hits(keyed: DataFrame, chunks) -> DataFrame:
    """(row, n_words, spans, items) of the rows (row, text) that any chunk hits."""
    hit = None
    for chunk in chunks:
        part = _scanned(keyed, "text", Windows(chunk)).drop("text")
        part = stage(part.filter(F.size("items") > 0), "decontam-hits")
        hit = part if hit is None else hit.unionByName(part)
    joined = hit.groupBy("row").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def merge(batches):
        for batch in batches:
            spans = [[{"a": a, "b": b} for a, b in merged((x["a"], x["b"]) for x in each)] for each in batch.column("spans").to_pylist()]
            columns = {c: batch.column(c) for c in batch.schema.names} | {"spans": pa.array(spans, _TYPES["spans"])}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return joined.mapInArrow(merge, joined.schema)


def _kept(docs: DataFrame, text: str, windows: Windows, max_share: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def run(batches):
        found = shared.value
        for batch in batches:
            clean = []
            for value in batch.column(text):
                words = benchmark_words(value.as_py())
                hit = sum(b - a for a, b in found.scan(words)[0])
                clean.append(hit <= max_share * len(words))
            yield batch.filter(pa.array(clean, pa.bool_()))

    return in_batches(docs).mapInArrow(run, docs.schema)


def remove_spans(text: str | None, spans) -> str | None:
    """``text`` without the words of the intervals and the separators inside them."""
    if not text or not spans:
        return text
    raw = text.encode("utf-8", "replace")
    mask = np.frombuffer(raw.translate(_WORD_BYTES), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")

