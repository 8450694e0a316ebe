"""Maximal periodic runs of word sequences, and texts without their repeats.

A run of period p and at least 2p words holds exactly one grid point i (a multiple of p) among
its first p words, and the words i and i + p are equal. So the harmonic grid, all pairs
(i, i + p) with p dividing i, n log n pairs in all, meets every run once for each of its
periods; how far both sides agree before and after the pair gives the run.

How far two positions agree (LCE) is answered from a sample of the suffixes: those at
positions that lie, modulo ``V``, in a difference cover. Only these are sorted. Any two
positions reach a sampled pair within V steps, so a few words are compared, then a
range-minimum query over the sampled suffixes' common prefixes (a sparse table) tells the
rest. The sample is built for texts only where a pair gets that far.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.shared import in_batches

LEAST = 12
# every residue modulo V is the difference of two of these (fixed values)
V = 31
COVER = (1, 5, 11, 24, 25, 27)
_START = {(b - a) % V: a for a in reversed(COVER) for b in reversed(COVER)}
_FIRST = np.array([_START[d] for d in range(V)])
# pairs are compared over at least so many words before the sample is asked
_FEW = 8
_BLOCK = 1 << 16


class SampledSuffixes:
    """Common prefixes of any two suffixes of ``words`` (ids from 0), from the sampled ones."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.n = n
        # the end differs from every word
        self.padded = np.concatenate([words, np.full(2 * V + 1, -1, words.dtype)])
        residues = [r for r in COVER if r < n]
        groups = [np.arange(r, n, V) for r in residues]
        at = np.concatenate(groups) if groups else np.zeros(0, np.int64)
        m = len(at)
        stop = np.cumsum([len(g) for g in groups])
        self.base = np.full(V, -1)
        self.base[residues] = stop - [len(g) for g in groups]
        class_end = np.repeat(stop, [len(g) for g in groups])
        blocks = np.ascontiguousarray(self.padded[at[:, None] + np.arange(V)])
        order = blocks.view(np.dtype((np.void, blocks.dtype.itemsize * V))).ravel()
        rank = np.unique(order, return_inverse=True)[1].reshape(-1) if m else at
        # ranks of 1, 2, 4, ... blocks, until all differ
        levels, step, index = [rank], 1, np.arange(m)
        while m and rank.max() < m - 1:
            later = index + step
            inside = later < class_end
            next_rank = np.where(inside, rank[np.where(inside, later, 0)], -1)
            rank = np.unique(rank * (m + 1) + next_rank + 1, return_inverse=True)[1].reshape(-1)
            levels.append(rank)
            step *= 2
        self.rank = rank
        suffixes = np.empty(m, np.int64)
        suffixes[rank] = index
        self.table = [self._neighbours(suffixes, levels, class_end, blocks)] if m > 1 else [np.zeros(0, np.int64)]
        width = 1
        while 2 * width < m:
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    @staticmethod
    def _neighbours(suffixes, levels, class_end, blocks) -> np.ndarray:
        """Common prefix, in words, of each sampled suffix and the next in order."""
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        end_a, end_b = class_end[a], class_end[b]
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = (a < end_a) & (b < end_b)
            same = inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)])
            common[same] += V << k
            a[same] += 1 << k
            b[same] += 1 << k
        inside = np.flatnonzero((a < end_a) & (b < end_b))
        common[inside] += (blocks[a[inside]] != blocks[b[inside]]).argmax(axis=1)
        return common

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """LCE of each pair of different positions up to n."""
        i, j = np.minimum(i, j), np.maximum(i, j)
        steps = (_FIRST[(j - i) % V] - i) % V
        out, left = np.zeros(len(i), np.int64), np.arange(len(i))
        for _ in range(V):
            go = out[left] < steps[left]
            go[go] = self.padded[i[left[go]] + out[left[go]]] == self.padded[j[left[go]] + out[left[go]]]
            left = left[go]
            if not len(left):
                break
            out[left] += 1
        # those that reached a sampled pair inside the text ask the table
        full = np.flatnonzero((out == steps) & (j + steps < self.n))
        a, b = i[full] + steps[full], j[full] + steps[full]
        ra, rb = (self.rank[self.base[x % V] + x // V] for x in (a, b))
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        k = np.frexp((high - low).astype(float))[1] - 1
        for level in np.unique(k):
            here = np.flatnonzero(k == level)
            row = self.table[level]
            out[full[here]] += np.minimum(row[low[here]], row[high[here] - (1 << level)])
        return out


@lru_cache(maxsize=4)
def _grid(first: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(j, p) for all multiples j of p with first <= j < stop, by j."""
    p = np.arange(1, stop)
    low = np.maximum(-(-first // p), 1)
    counts = np.maximum((stop - 1) // p - low + 1, 0)
    period = np.repeat(p, counts)
    k = np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
    j = k * period
    order = np.argsort(j, kind="stable")
    return j[order].astype(np.int32), period[order].astype(np.int32)


def _grid_pairs(n: int):
    """Blocks of pairs (i, i + p) of the grid, 2p <= n; parts of fixed tables, so the work is that of the pairs."""
    for first in range(0, n, _BLOCK):
        j, p = _grid(first, first + _BLOCK)
        size = np.searchsorted(j, n)
        fits = 2 * p[:size] <= n
        yield (j[:size] - p[:size])[fits].astype(np.int64), p[:size][fits].astype(np.int64)


def runs(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of every run of ids, by start, then period.

    A run is a maximal stretch with smallest period p and at least max(least, 2p) words.
    """
    n = len(words)
    empty = np.zeros((0, 3), np.int64)
    if n < max(least, 2):
        return empty
    edged = np.concatenate([[-1], words, [-2]])
    found, forward, backward = [], None, None
    for i, p in _grid_pairs(n):
        same = words[i] == words[i + p]
        i, p = i[same], p[same]
        after, open_after = _compare(edged, i + 1, p, 1)
        before, open_before = _compare(edged, i, p, -1)
        # a pair that both sides closed too early is no run
        can = open_after | open_before | (after + before >= np.maximum(p, least - p))
        i, p, after, before, open_after, open_before = (x[can] for x in (i, p, after, before, open_after, open_before))
        if open_after.any():
            forward = forward or SampledSuffixes(words)
            after[open_after] = forward.common(i[open_after], (i + p)[open_after])
        if open_before.any():
            backward = backward or SampledSuffixes(words[::-1].copy())
            before[open_before] = backward.common((n - i)[open_before], (n - i - p)[open_before])
        length = p + after + before
        keep = (before < p) & (length >= np.maximum(least, 2 * p))
        found.append(np.stack([(i - before)[keep], length[keep], p[keep]], axis=1))
    got = np.concatenate(found) if found else empty
    # one stretch has one smallest period, its other periods are multiples
    got = got[np.lexsort((got[:, 2], got[:, 1], got[:, 0]))]
    first = np.ones(len(got), bool)
    first[1:] = (got[1:, :2] != got[:-1, :2]).any(axis=1)
    got = got[first]
    return got[np.lexsort((got[:, 2], got[:, 0]))]


def _compare(edged: np.ndarray, at: np.ndarray, p: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal words of each pair from ``at`` on, and which pairs agree on all of the few compared."""
    out, left = np.zeros(len(at), np.int64), np.arange(len(at))
    for k in range(_FEW):
        a = at[left] + way * k
        left = left[edged[a] == edged[a + p[left]]]
        if not len(left):
            break
        out[left] += 1
    still = np.zeros(len(at), bool)
    still[left] = True
    return out, still


def covered(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edge)[:n] > 0


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, as UTF-8."""
    return text.encode("utf-8", "replace").split() if text else []


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic tail where the id's checksum ends in 0; else as they are."""
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if not n or h is None or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, edit=None) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) for every row of ``docs``.

    ``start``, ``length`` and ``period`` are of the longest run (ties: smallest start, then
    period), null without a run. ``runs_sha256`` digests the lines ``start,length,period`` of
    all runs, ``collapsed_sha256`` the text left without the words that a run repeats.
    ``edit(words, doc_id)`` may change the words before. Null and empty texts have no words and
    no runs. Repeated rows and rows without an id are kept; other columns are ignored. Every
    row is worked on by itself: nothing is shuffled, and memory is a few times the longest text.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def each(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [_described(id_, value, least, edit) for id_, value in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)]
                kinds = [part.schema.field("doc_id").type, *[pa.int64()] * 5, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return in_batches(rows).mapInArrow(each, schema)


def _described(doc_id, text: str | None, least: int, edit) -> tuple:
    words = words_of(text)
    if edit:
        words = edit(words, doc_id)
    ids = defaultdict(count().__next__)
    found = runs(np.fromiter((ids[w] for w in words), np.int32, len(words)), least)
    top, left = (None,) * 4, words
    if len(found):
        start, length, period = (int(x) for x in found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]])
        top = start, length, period, 1000 * length // period
        left = [w for w, gone in zip(words, covered(len(words), found).tolist(), strict=True) if not gone]
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
    return doc_id, len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest()
