"""Alignment of two tokenizers over a corpus: each distinct text once, weighed by its copies.

1. Texts are shuffled whole, so that equal ones meet; each distinct one is tokenised by both
   tokenizers and aligned once, and its pair counts are weighed by the number of its copies.
2. Pair counts are summed over the corpus; the highest of each id of the second tokenizer is
   marked. The frequent pairs (at most ``HOT``, whatever the corpus) are broadcast, the
   others join by a shuffle; a rare pair is no hot key by definition.
3. The measures of each distinct text go back to its documents by the digest of the text.
   Texts with many copies (at most ``HOT_TEXTS``) are broadcast, so no copies meet in a task.

Neither tokenizer has a token over a space or line break that follows text, so both end a
token there. A text is cut at such places, and the parts, which repeat, are remembered by
each worker up to a bound.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.shared import in_batches, stage

HOT = 1 << 19
HOT_TEXTS = 4096
# parts that a worker remembers, and bytes of what it knows of them
_CACHE = 400_000
_CACHE_BYTES = 150_000_000
# so many new parts are tokenised as one text
_JOINT = 512
# longer parts go to the reference library: the fast one may run out of stack on them
_LONG = 10_000
_SPACE = r" \t\n\x0b\x0c\r\xa0  -     　"
_PART = re.compile(rf"[ \n][{_SPACE}]*[^ \n]*(?:(?<=[{_SPACE}])[ \n][{_SPACE}]*[^ \n]*)*")
# white space to some regular expression engines only: texts with these are not cut
_DOUBTFUL = re.compile(r"[\x1c-\x1f\x85᠎​﻿]")
# the pre-token rule of byte-level BPE files that use the default one (fixed value)
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TwoTokenizers:
    """Tokens of a part under both files, as ids with their byte lengths."""

    def __init__(self, byte_bpe: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(byte_bpe, encoding="utf-8") as file:
            spec = json.load(file)
        cut = spec["pre_tokenizer"] or {}
        if cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{byte_bpe}: not a byte-level BPE file with the default pre-token rule")
        self.library = Tokenizer.from_file(byte_bpe)
        self.library.encode_special_tokens = True
        letters, special = _byte_of_letter(), {t["content"] for t in spec["added_tokens"]}
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}
        self.fast = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(x)) else x.replace("▁", " ").encode() for x in names]
        self.space = self.b.piece_to_id("▁")
        # parts are cut apart only where no token of either file can reach over the cut
        self.separable = self.b.encode("a b") == self.b.encode("a") + self.b.encode("b") and not any(
            re.search("[^▁][▁\n]", x) for x in names) and not any("\n" in x and len(x) > 1 for x in names)
        self.a_length, self.b_length = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        # ids as text, with what may follow them
        self.a_text, self.b_text = ({end: np.array([f"{i}{end}" for i in range(n)], object) for end in ends}
                                    for n, ends in ((len(self.a_bytes), ",|"), (len(names), [",", ";", ""])))

    def parts(self, text: str) -> list[str]:
        """The text with its leading space, cut where both tokenizers end a token."""
        given = " " + text
        return _PART.findall(given) if self.separable and not _DOUBTFUL.search(given) else [given]

    def encode(self, parts: list[str]) -> list[tuple[list[int], list[int]]]:
        # the piece model puts a space before; a part that begins with a line break loses that piece again
        found = self.b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        b = [ids or [self.space] if p[0] == " " else ids[1:] if ids[:1] == [self.space] else [] for p, ids in zip(parts, found, strict=True)]
        a = [self.library.encode(p, add_special_tokens=False).ids if len(p) > _LONG or _DOUBTFUL.search(p) else self.fast.encode_ordinary(p) for p in parts]
        return list(zip(a, b, strict=True))

    def align(self, parts: list[str]) -> list[tuple | None]:
        """(tokens of A, of B, groups, links, ids of the groups as text, linked pairs) of each part; None unless both give its bytes."""
        out: list[tuple | None] = [None] * len(parts)
        joint = [i for i, p in enumerate(parts) if self.separable and len(p) <= _LONG and p[0] in " \n" and not p[-1].isspace()]
        alone = set(range(len(parts))).difference(joint)
        for at in range(0, len(joint), _JOINT):
            some = joint[at: at + _JOINT]
            found = self._together([parts[i] for i in some])
            if found is None:
                alone.update(some)
            else:
                for i, x in zip(some, found, strict=True):
                    out[i] = x
        rest = sorted(alone)
        tokens, whole = self.encode([parts[i] for i in rest]), [parts[i].encode("utf-8", "replace") for i in rest]
        faithful = [b"".join([self.a_bytes[i] for i in a]) == w == b"".join([self.b_bytes[i] for i in b]) for w, (a, b) in zip(whole, tokens, strict=True)]
        good = [i for i, x in enumerate(faithful) if x]
        flat = [np.fromiter(chain.from_iterable(tokens[i][k] for i in good), np.int64) for k in (0, 1)]
        sizes = [np.array([len(tokens[i][k]) for i in good], np.int64) for k in (0, 1)]
        for i, x in zip(good, self._aligned([whole[i] for i in good], *flat, *sizes), strict=True):
            out[rest[i]] = x
        return out

    def _together(self, parts: list[str]) -> list[tuple] | None:
        """Parts tokenised as one text, for no token reaches from one into the next; None if some do not come out as they are."""
        text = "".join(parts)
        if _DOUBTFUL.search(text):
            return None
        ids = self.b.encode(text[1:] if text[0] == " " else text)
        if text[0] != " ":
            if ids[:1] != [self.space]:
                return None
            ids = ids[1:]
        found, raw = (self.fast.encode_ordinary(text), ids), text.encode("utf-8", "replace")
        for tokens, of in zip(found, (self.a_bytes, self.b_bytes), strict=True):
            if b"".join([of[i] for i in tokens]) != raw:
                return None
        whole = [p.encode("utf-8", "replace") for p in parts]
        stop = np.cumsum([len(w) for w in whole])
        flat, sizes = [np.array(tokens, np.int64) for tokens in found], []
        for tokens, length in zip(flat, (self.a_length, self.b_length), strict=True):
            ends = np.cumsum(length[tokens])
            last = np.searchsorted(ends, stop)
            if (ends[last] != stop).any():
                return None
            sizes.append(np.diff(last, prepend=-1))
        return self._aligned(whole, *flat, *sizes)

    def _aligned(self, whole: list[bytes], a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[tuple]:
        """All parts laid end to end, so that one pass over the ends of all tokens aligns them."""
        if not whole:
            return []
        end_a, end_b = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        end = np.cumsum([len(w) for w in whole])
        # between two ends of any token lies one link, up to an end of both a group
        either, both = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b, assume_unique=True)
        pairs = a[np.searchsorted(end_a, either)] << 32 | b[np.searchsorted(end_b, either)]
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        last_a, last_b = both[group_a] == end_a, both[group_b] == end_b
        text = np.empty(len(a) + len(b), object)
        text[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = np.where(last_a, self.a_text["|"][a], self.a_text[","][a])
        of_b = np.where(last_b, self.b_text[";"][b], self.b_text[","][b])
        stop = np.cumsum(n_b) - 1
        of_b[stop] = self.b_text[""][b[stop]]
        text[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = of_b
        texts = text.tolist()
        to_text, to_link, to_group = (np.concatenate([[0], x]).tolist() for x in (
            np.cumsum(n_a + n_b), np.searchsorted(either, end, "right"), np.searchsorted(both, end, "right")))
        out = []
        for i, (x, y) in enumerate(zip(n_a.tolist(), n_b.tolist(), strict=True)):
            links, groups = to_link[i + 1] - to_link[i], to_group[i + 1] - to_group[i]
            out.append((x, y, groups, links, "".join(texts[to_text[i]: to_text[i + 1]]), pairs[to_link[i]: to_link[i + 1]].tobytes()))
        return out


class Aligner:
    """Parts aligned by both tokenizers, each in a slot; one in each Python worker, whatever the number of its tasks."""

    def __init__(self, byte_bpe: str, pieces: str):
        self.two = TwoTokenizers(byte_bpe, pieces)
        self.slot: dict[str, int] = {}
        self.text: list[str] = []
        self.pairs: list[bytes] = []
        self.size = 0
        self.counts = np.zeros((0, 4), np.int64)
        # how often since the last count, and how often of late
        self.times, self.uses = np.zeros(0, np.int64), np.zeros(0)
        self.generation = 0

    def slots(self, parts: list[str]) -> np.ndarray:
        """The slot of each part; new parts are aligned all at once. Parts that are not given back have no links."""
        out = np.fromiter(map(self.slot.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(out < 0).tolist()
        if missing:
            new = list(dict.fromkeys([parts[i] for i in missing]))
            found = [x or (0, 0, 0, 0, "", b"") for x in self.two.align(new)]
            self.slot.update(zip(new, range(len(self.text), len(self.text) + len(new)), strict=True))
            self.text += [x[4] for x in found]
            self.pairs += [x[5] for x in found]
            self.size += sum(len(p) + len(x[4]) + len(x[5]) for p, x in zip(new, found, strict=True))
            self.counts = np.concatenate([self.counts, np.array([x[:4] for x in found], np.int64)])
            self.times = np.concatenate([self.times, np.zeros(len(new), np.int64)])
            self.uses = np.concatenate([self.uses, np.zeros(len(new))])
            out[missing] = [self.slot[parts[i]] for i in missing]
        self.uses += np.bincount(out, minlength=len(self.uses))
        return out

    def full(self) -> bool:
        return len(self.text) > _CACHE or self.size > _CACHE_BYTES

    def forget(self) -> None:
        """Keeps the half of the parts that was used most; slots change, counts start from 0."""
        kept = np.argsort(-self.uses, kind="stable")[: min(len(self.text), _CACHE) // 2]
        while len(kept) and sum(len(self.text[i]) + len(self.pairs[i]) for i in kept) > _CACHE_BYTES // 2:
            kept = kept[: len(kept) // 2]
        new = np.full(len(self.text), -1)
        new[kept] = np.arange(len(kept))
        slots = new.tolist()
        self.slot = {p: slots[i] for p, i in self.slot.items() if slots[i] >= 0}
        self.text, self.pairs = [self.text[i] for i in kept], [self.pairs[i] for i in kept]
        self.size = sum(map(len, self.slot)) + sum(map(len, self.text)) + sum(map(len, self.pairs))
        self.counts, self.times, self.uses = self.counts[kept], np.zeros(len(kept), np.int64), self.uses[kept] / 2
        self.generation += 1

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs and their counts; counts start from 0 again."""
        used = np.flatnonzero(self.times)
        pairs = np.frombuffer(b"".join([self.pairs[i] for i in used]), np.int64)
        times = np.repeat(self.times[used], self.counts[used, 3])
        order = np.argsort(pairs, kind="stable")
        pairs, times = pairs[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
        self.times[:] = 0
        return pairs[first], np.add.reduceat(times, first) if len(first) else times


@lru_cache(maxsize=2)
def _aligner(byte_bpe: str, pieces: str) -> Aligner:
    return Aligner(byte_bpe, pieces)


def _slices(batches, rows: int = 128):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _starts(cut: list[list[str]]) -> np.ndarray:
    """Where the parts of each text begin; a text has one part at least."""
    return np.concatenate([[0], np.cumsum([len(parts) for parts in cut])[:-1]]).astype(np.int64)


def align_tokenizers(
    docs: DataFrame, byte_bpe: str, pieces: str, doc_id: str = "doc_id", text: str = "text",
    hot: int = HOT, hot_texts: int = HOT_TEXTS,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    ``byte_bpe`` (A, a byte-level BPE file) and ``pieces`` (B, a piece model) are paths readable
    on every executor. Each text is tokenised with a space before it, special strings as plain
    text. Where A and B tokens both end, a group ends; A and B tokens whose bytes overlap are
    linked. ``n_best`` counts the links whose pair is the most frequent of its B id in the
    corpus, ``count_sum`` adds the corpus counts of all links. Null and empty texts, and those
    that one of the two does not give back byte for byte, have zeros and an empty digest.
    Repeated rows and rows without an id are kept and counted; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    distinct = rows.filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))

    def align(batches):
        aligner = _aligner(byte_bpe, pieces)
        aligner.times[:] = 0  # a task that broke off may have left some
        for batch in _slices(batches):
            texts, copies = batch.column("text").to_pylist(), batch.column("copies").to_numpy()
            cut = [aligner.two.parts(t) for t in texts]
            slots, starts = aligner.slots([p for parts in cut for p in parts]), _starts(cut)
            good = np.logical_and.reduceat(aligner.counts[slots, 0] > 0, starts)
            np.add.at(aligner.times, slots, np.repeat(np.where(good, copies, 0), [len(parts) for parts in cut]))
            sums = np.add.reduceat(aligner.counts[slots], starts).tolist()
            groups = [aligner.text[i] for i in slots.tolist()]
            out = []
            for i, (at, parts) in enumerate(zip(starts.tolist(), cut, strict=True)):
                if good[i]:
                    digest = hashlib.sha256(";".join(groups[at: at + len(parts)]).encode()).hexdigest()
                    out.append((texts[i], int(copies[i]), *sums[i], digest))
            yield _batch(out)
            if aligner.full():
                yield _pairs(*aligner.counted())
                aligner.forget()
        yield _pairs(*aligner.counted())

    kinds = "text string, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, n long"
    aligned = stage(in_batches(distinct).mapInArrow(align, kinds), "aligned-texts")
    summed = aligned.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = stage(summed, "pair-counts").withColumn("b", F.expr("pair & 4294967295"))
    highest = pairs.groupBy("b").agg(F.max("n").alias("most"))
    pairs = stage(pairs.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-best")

    # the count from which on a pair is hot, from a histogram of 16 steps an octave
    step = F.floor(F.log2("n") * 16).cast("int")
    least, total = None, 0
    for row in pairs.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if total + row["count"] > hot:
            break
        least, total = row["step"], total + row["count"]
    is_hot = F.lit(False) if least is None else step >= least
    table = pairs.filter(is_hot).orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

    def measure(batches):
        aligner, (keys, counts, best) = _aligner(byte_bpe, pieces), shared.value
        # of each slot: links that are the best of their B id, sum of counts, links whose pair is rare
        known, generation = np.zeros((0, 3), np.int64), aligner.generation

        def more(first: int) -> np.ndarray:
            flat, stop = np.frombuffer(b"".join(aligner.pairs[first:]), np.int64), np.cumsum(aligner.counts[first:, 3])
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            hit = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            each = np.zeros((len(flat) + 1, 3), np.int64)
            each[1:][hit, 0], each[1:][hit, 1], each[1:, 2] = best[at[hit]], counts[at[hit]], ~hit
            sums = np.cumsum(each, axis=0)
            return sums[stop] - sums[np.concatenate([[0], stop[:-1]]).astype(np.int64)]

        for batch in _slices(batches):
            cut = [aligner.two.parts(t) for t in batch.column("text").to_pylist()]
            slots, starts = aligner.slots([p for parts in cut for p in parts]), _starts(cut)
            if generation != aligner.generation:
                known, generation = known[:0], aligner.generation
            known = np.concatenate([known, more(len(known))]) if len(known) < len(aligner.text) else known
            own = np.add.reduceat(known[slots], starts)
            rare = []
            for i in np.flatnonzero(own[:, 2]).tolist():
                mine = slots[starts[i]: starts[i] + len(cut[i])]
                pairs = np.frombuffer(b"".join([aligner.pairs[k] for k in mine[known[mine, 2] > 0]]), np.int64)
                at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                values, n = np.unique(pairs[keys[at] != pairs] if len(keys) else pairs, return_counts=True)
                digest = batch.column("digest")[i].as_py()
                rare += [(digest, p, c) for p, c in zip(values.tolist(), n.tolist(), strict=True)]
            yield _measured(batch, own[:, :2].tolist(), rare)
            if aligner.full():
                aligner.forget()

    carried = "copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    given = aligned.filter("pair IS NULL").withColumn("digest", F.sha2("text", 256))
    parts = given.mapInArrow(measure, f"digest string, {carried}, best long, total long, pair long, times long")
    top = F.when(F.col("pair").isNull(), F.col("best_here")).otherwise(F.when(F.col("best"), F.col("times")).otherwise(0))
    joined = parts.withColumnRenamed("best", "best_here").join(pairs.filter(~is_hot), "pair", "left")
    total_of = F.when(F.col("pair").isNull(), F.col("total")).otherwise(F.col("times") * F.col("n"))
    by_text = stage(joined.groupBy("digest").agg(
        *[F.max(c).alias(c) for c in ("copies", *MEASURES[:4], "groups_sha256")],
        F.sum(top).alias("n_best"), F.sum(total_of).alias("count_sum"),
    ), "text-measures")

    # of n copies in all, fewer than hot_texts texts have over n / hot_texts
    copies = by_text.agg(F.sum("copies")).first()[0] or 0
    often = F.col("copies") > max(1, copies // hot_texts)
    own = [*MEASURES, "groups_sha256"]
    named = lambda df, mark: df.select(F.col("digest").alias(f"_{mark}"), *[F.col(c).alias(f"{c}_{mark}") for c in own])
    each = rows.select("doc_id", F.sha2("text", 256).alias("digest"))
    each = each.join(F.broadcast(named(by_text.filter(often), "hot")), F.col("digest") == F.col("_hot"), "left")
    # rows that need no join are spread by a key that no digest equals
    alone = F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string"))
    each = each.withColumn("key", F.when(F.col("digest").isNull() | F.col("_hot").isNotNull(), alone).otherwise(F.col("digest")))
    each = each.join(named(by_text.filter(~often), "cold"), F.col("key") == F.col("_cold"), "left")
    found = lambda c, empty: F.coalesce(f"{c}_hot", f"{c}_cold", F.lit(empty)).alias(c)
    return each.select("doc_id", *[found(c, 0) for c in MEASURES], found("groups_sha256", ""))


_KINDS = [("text", pa.string()), *[(c, pa.int64()) for c in ("copies", *MEASURES[:4])], ("groups_sha256", pa.string()), ("pair", pa.int64()), ("n", pa.int64())]


def _batch(texts: list[tuple]) -> pa.RecordBatch:
    """Rows of texts."""
    columns = [*zip(*texts, strict=True)] if texts else [()] * 7
    out = [pa.array(c, kind) for c, (_, kind) in zip(columns, _KINDS, strict=False)]
    return pa.RecordBatch.from_arrays([*out, *[pa.nulls(len(texts), pa.int64())] * 2], names=[name for name, _ in _KINDS])


def _pairs(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of pair counts."""
    return pa.RecordBatch.from_arrays([*[pa.nulls(len(pairs), kind) for _, kind in _KINDS[:7]], pa.array(pairs), pa.array(n)], names=[name for name, _ in _KINDS])


def _measured(batch: pa.RecordBatch, own: list[tuple], rare: list[tuple]) -> pa.RecordBatch:
    """A row for each text, then one for each of its rare pairs."""
    b = len(rare)
    names = ["digest", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    out = [pa.concat_arrays([batch.column("digest"), pa.array([r[0] for r in rare], pa.string())])]
    out += [pa.concat_arrays([batch.column(c), pa.nulls(b, batch.column(c).type)]) for c in names[1:]]
    out += [pa.array([*[x[i] for x in own], *[None] * b], pa.int64()) for i in (0, 1)]
    out += [pa.array([*[None] * len(own), *[r[i] for r in rare]], pa.int64()) for i in (1, 2)]
    return pa.RecordBatch.from_arrays(out, names=[*names, "best", "total", "pair", "times"])
