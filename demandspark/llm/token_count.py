"""Token counts without ids: pieces once per distinct pre-token, summed by frequency.

1. The frequent pre-tokens (at most ``HOT``, whatever the corpus) are found on the documents of
   one of ``SAMPLE`` hash classes, and their pieces are counted. That decides only which way a
   pre-token goes, never a count.
2. Every text is cut once into pre-tokens by the tokenizer's own rules. Those of the frequent
   table, which is broadcast, are summed at once; frequencies of the others go by document.
3. Those meet by pre-token in a shuffle, which has no hot key as the frequent ones are gone; the
   pieces of each distinct one are counted once, times its frequencies, and summed by document.

A text is first cut at white space that follows text: no pre-token crosses such a place.
The units repeat, so the tokenizer's rules run once for each distinct one in a task.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.shared import in_batches, stage

HOT = 1 << 17
SAMPLE = 16
_CACHE = 120_000
_SPACE = r"\t-\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
# white space to some regular expression engines only: such texts are not cut into units
_DOUBTFUL = re.compile(r"[\x1c-\x1f\x85\u180e\u200b\ufeff]")


_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
# a word, perhaps with marks after it: the common case, cut here as the tokenizer cuts it
_WORD = re.compile(f"( ?[{_LETTERS}]+)([.,;:!?]*)")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """Loaded once in each Python worker, whatever the number of its tasks; without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PreTokens:
    """Units and pre-tokens of texts under a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = set(added)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def units(self, text: str | None) -> list[str]:
        """Parts of a text between which no pre-token reaches."""
        if not text:
            return []
        # the tokenizer takes the strings of added tokens out of a text first
        if self.special and self.special.search(text):
            return [u for i, x in enumerate(self.special.split(text)) if x for u in ([x] if i % 2 else self.units(x))]
        return [text] if _DOUBTFUL.search(text) else _UNIT.findall(text)

    def cut(self, unit: str) -> list[str]:
        """The pre-tokens of a unit."""
        word = _WORD.fullmatch(unit)
        if word:
            return [word[1], word[2]] if word[2] else [unit]
        if unit in self.added:
            return [unit]
        return [unit[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(unit)]

    def frequencies(self, units: Counter) -> dict[str, int]:
        found: dict[str, int] = {}
        for unit, n in units.items():
            for part in self.cut(unit):
                found[part] = found.get(part, 0) + n
        return found


class KnownPieces(dict):
    """By unit: the pieces of its hot pre-tokens, and its other pre-tokens."""

    def __init__(self, pre: PreTokens, hot: dict[str, int]):
        super().__init__()
        self.pre, self.hot = pre, hot

    def __missing__(self, unit: str) -> tuple[int, tuple[str, ...]]:
        if len(self) >= _CACHE:  # the older half goes
            for known in list(islice(self, _CACHE // 2)):
                del self[known]
        sizes = [(part, self.hot.get(part)) for part in self.pre.cut(unit)]
        self[unit] = found = sum(n for _, n in sizes if n), tuple(part for part, n in sizes if n is None)
        return found


def count_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``.

    ``tokenizer`` is the path of a byte-level BPE file, readable on every executor. No
    begin, end or other special token is added; special strings inside texts count as the
    tokenizer's default has it. Null and empty texts have 0 bytes and 0 tokens. Repeated
    rows are returned as often as they come, and other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def frequencies(batches):
        pre, found = PreTokens(tokenizer), Counter()
        for batch in batches:
            for value in batch.column("text"):
                found.update(pre.units(value.as_py()))
                if len(found) >= _CACHE:
                    yield _counted(pre.frequencies(found))
                    found = Counter()
        yield _counted(pre.frequencies(found))

    def pieces(batches):
        library = PreTokens(tokenizer).tokenizer
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                got = library.encode_batch(part.column("token").to_pylist(), add_special_tokens=False)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(e.ids) for e in got], pa.int32())], names=["token", "n", "pieces"])

    sampled = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0)
    seen = sampled.select("text").mapInArrow(frequencies, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counted = stage(in_batches(seen).mapInArrow(pieces, "token string, n long, pieces int"), "token-pieces")

    # the frequency from which on a pre-token is hot, from a histogram of 16 steps an octave
    step = F.floor(F.log2("n") * 16).cast("int")
    least, total = None, 0
    for row in counted.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if total + row["count"] > hot:
            break
        least, total = row["step"], total + row["count"]
    is_hot = F.lit(False) if least is None else step >= least
    table = {r["token"]: r["pieces"] for r in counted.filter(is_hot).select("token", "pieces").toLocalIterator()}
    shared = spark.sparkContext.broadcast(table)

    def split(batches):
        pre = PreTokens(tokenizer)
        known = KnownPieces(pre, shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [[] for _ in range(6)]
                for id_, value in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    text = value.as_py()
                    raw = (text or "").encode("utf-8", "replace")
                    key, here, rare = xxhash.xxh3_64_intdigest(raw) - (1 << 63), 0, {}
                    for unit, n in Counter(pre.units(text)).items():
                        size, others = known[unit]
                        here += n * size
                        for token in others:
                            rare[token] = rare.get(token, 0) + n
                    for row in ((id_, key, len(raw), here, None, 1), *((id_, key, 0, 0, t, n) for t, n in rare.items())):
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
                kinds = [part.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "key", "n_bytes", "here", "token", "n"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = in_batches(rows).mapInArrow(split, f"doc_id {kind}, key long, n_bytes long, here long, token string, n long")

    def counted_rows(batches):
        """Rows of a pre-token come one after another; the row of a document itself has none."""
        library = PreTokens(tokenizer).tokenizer
        last: tuple = (None, 0)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                tokens = part.column("token").dictionary_encode()
                values = tokens.dictionary.to_pylist()
                new = [v for v in values if v != last[0]]
                sizes = dict(zip(new, (len(e.ids) for e in library.encode_batch(new, add_special_tokens=False)), strict=True))
                sizes[last[0]] = last[1]
                if values:
                    last = values[-1], sizes[values[-1]]
                own = pc.is_null(part.column("token"))
                each = pa.array([sizes[v] for v in values], pa.int64()).take(tokens.indices)
                here = pc.if_else(own, part.column("here"), pc.multiply(each, part.column("n")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), part.column("n_bytes"), here, pc.cast(own, pa.int64())],
                    names=["doc_id", "key", "n_bytes", "here", "copies"])

    # pre-tokens meet; the rows of documents, which have none, are spread by their key
    route = F.when(F.col("token").isNull(), F.col("key")).otherwise(F.xxhash64("token"))
    met = parts.repartition(route).sortWithinPartitions("token")
    met = met.mapInArrow(counted_rows, f"doc_id {kind}, key long, n_bytes long, here long, copies long")
    by_doc = met.groupBy("doc_id", "key").agg(
        F.sum("copies").alias("copies"), F.max("n_bytes").alias("n_bytes"), F.sum("here").alias("tokens"))
    each = by_doc.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("doc_id", "n_bytes", F.expr("tokens div copies").alias("n_tokens"))


def _counted(found: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["token", "n"])
