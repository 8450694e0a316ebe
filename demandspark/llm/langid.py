"""Language identification with one bit-sliced Bloom filter for all languages.

Row ``i`` of the filter is a bit mask of languages. The character n-grams that belong to a
language set its bit in ``HASHES`` rows; the AND of an n-gram's rows is the set of languages
that contain it. A text's n-grams are looked up once for all languages; the hits of each
language, less those expected by chance from how full its slice is, decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.shared import in_batches, stage

GRAM = 4
HASHES = 3
ROWS = 1 << 20
# n-grams of a language's filter: those at least so often there, a million n-grams ...
LEAST_PER_MILLION = 8.0
# ... and at least this part as often as in the language that has them most
LEAST_SHARE = 0.3
# Training is on a sample of labelled documents whose bound does not grow with the data.
SAMPLE_DOCS = 40_000
UNDETERMINED = "und"
# least share of a text's n-grams in its language: below it is in none that was learnt
LEAST_PART = 0.02
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter, made once in each worker."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(text: str | None) -> np.ndarray:
    """Hashes of the n-grams of a whole text, lower-cased, runs of other than letters as one 0."""
    if not text:
        return np.empty(0, np.uint64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(_letters()[codes], codes, 0)
    if not codes.any():
        return np.empty(0, np.uint64)
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint64)
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    length = min(GRAM, len(codes))
    n = len(codes) - length + 1
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out = (out ^ codes[i : n + i]) * _FACTORS[0]
        out ^= out >> np.uint64(31)
    return out


def slots(values: np.ndarray) -> list[np.ndarray]:
    """The rows of the filter that belong to each value, one array a hash."""
    return [((values * f) >> np.uint64(64 - (ROWS.bit_length() - 1))).astype(np.int64) for f in _FACTORS[1 : HASHES + 1]]


@dataclass
class LanguageFilter:
    languages: list[str]
    masks: np.ndarray  # (ROWS, words) uint64: languages of each row

    def __post_init__(self):
        fill = np.array([self._bit(self.masks, i).mean() for i in range(len(self.languages))])
        self.by_chance = np.minimum(fill**HASHES, 0.999)

    @staticmethod
    def _bit(masks: np.ndarray, i: int) -> np.ndarray:
        return (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)

    def shares(self, text: str | None) -> np.ndarray | None:
        """The part of the text's n-grams in each language, corrected; None without letters."""
        return self._shares(grams(text))

    def _shares(self, values: np.ndarray) -> np.ndarray | None:
        if not len(values):
            return None
        rows = slots(values)
        found = self.masks[rows[0]]
        for r in rows[1:]:
            found &= self.masks[r]
        hits = np.array([self._bit(found, i).sum() for i in range(len(self.languages))]) / len(values)
        return np.clip((hits - self.by_chance) / (1 - self.by_chance), 0, 1)

    def decide(self, text: str | None) -> tuple[str, float]:
        """Language (ties: the first by name) and its part of all languages' shares."""
        shares = self.shares(text)
        if shares is None or not self.languages:
            return UNDETERMINED, 0.0
        best = int(np.argmax(shares))
        total = shares.sum()
        return self.languages[best], float(shares[best] / total) if total > 0 else 0.0


    def known(self, text: str | None) -> tuple[str, bool]:
        """Language as in ``decide``, and whether the text has more of its n-grams than chance explains.

        Chance gives the most hit of L languages a share of p + z sqrt(p (1 - p) / n) at most, but for
        a chance of about 1 in 1,000; and a text of no learnt language has parts in common with some,
        so at least ``LEAST_PART`` is asked for. Without a language learnt every text with a letter is known.
        """
        values = grams(text)
        shares = self._shares(values)
        if shares is None:
            return UNDETERMINED, False
        if not self.languages:
            return "", True
        best = int(np.argmax(shares))
        p = float(self.by_chance[best])
        noise = (3.1 + 0.5 * np.log(len(self.languages))) * np.sqrt(p * (1 - p) / len(values)) / (1 - p)
        return self.languages[best], bool(shares[best] > max(noise, LEAST_PART))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE_DOCS) -> LanguageFilter:
    """The filter of all languages in ``lang``; rows with null text or lang teach nothing.

    Each language gives about ``sample / languages`` documents at most, chosen by a hash of
    their id, so that rare languages are learnt from all they have.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageFilter([], np.zeros((ROWS, 1), np.uint64))
    part = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(sample / len(sizes) / sizes[k]))])
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.filter(draw < part[F.col("lang")]).select("text", "lang")
    number = {name: i for i, name in enumerate(languages)}

    def count(batches):
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for value, name in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                by_lang.setdefault(name, []).append(grams(value.as_py()))
            for name, parts in by_lang.items():
                values, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values.view(np.int64)), pa.array(np.full(len(values), number[name], np.int32)), pa.array(n)], names=["gram", "language", "n"]
                )

    counted = in_batches(chosen).mapInArrow(count, "gram long, language int, n long").groupBy("gram", "language").agg(F.sum("n").alias("n"))
    counted = stage(counted, "language-grams")
    total = counted.groupBy("language").agg(F.sum("n").alias("total"))
    rate = counted.join(F.broadcast(total), "language").withColumn("rate", F.col("n") * 1e6 / F.col("total"))
    top = rate.groupBy("gram").agg(F.max("rate").alias("top"))
    member = rate.join(top, "gram").filter((F.col("rate") >= LEAST_PER_MILLION) & (F.col("rate") >= LEAST_SHARE * F.col("top")))

    def place(batches):
        for batch in batches:
            values = batch.column("gram").to_numpy().view(np.uint64)
            where = slots(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(where).astype(np.int32)), pa.array(np.tile(batch.column("language").to_numpy(), HASHES))], names=["row", "language"]
            )

    masks = np.zeros((ROWS, (len(languages) + 63) // 64), np.uint64)
    # at most ROWS rows for each 64 languages reach the driver, whatever the corpus
    placed = member.select("gram", "language").mapInArrow(place, "row int, language int")
    bit = F.expr("shiftleft(1L, language % 64)")
    for row, word, mask in placed.groupBy("row", (F.col("language") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("mask")).toPandas().itertuples(index=False):
        masks[row, word] = np.uint64(int(mask) & 0xFFFFFFFFFFFFFFFF)
    return LanguageFilter(languages, masks)


def identify(docs: DataFrame, model: LanguageFilter, text: str = "text", language: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score; columns of these names are replaced.

    Null texts and texts without a letter are ``und`` with score 0.
    """
    docs = docs.drop(language, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            got = [shared.value.decide(v.as_py()) for v in batch.column(text)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=[*batch.schema.names, language, score],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return in_batches(docs).mapInArrow(run, f"{fields}{', ' if fields else ''}`{language}` string, `{score}` double")


def recognise(docs: DataFrame, model: LanguageFilter, text: str = "text", language: str = "lang_pred", known: str = "known") -> DataFrame:
    """``docs`` with the predicted language and whether the text is in it; columns of these names are replaced.

    Null texts and texts without a letter are ``und`` and not known.
    """
    docs = docs.drop(language, known)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            got = [shared.value.known(v.as_py()) for v in batch.column(text)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.bool_())],
                names=[*batch.schema.names, language, known],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return in_batches(docs).mapInArrow(run, f"{fields}{', ' if fields else ''}`{language}` string, `{known}` boolean")
