"""Documents from raw to mixed: five stages, each over all that the one before it kept.

``run(spark, sf_dir)`` applies the stages to ``documents``; every stage is written to the
shared folder as Parquet and read again, so that a lost executor costs one stage at most.
Null and empty texts, repeated rows and empty tables are handled as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.llm import decontam, langid, line_dedup, mixing, near_dup
from demandspark.llm.shared import free_names, stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those in no language that any row names.

    A text is in none if the share of its n-grams in the nearest language, corrected for chance
    hits, is what chance may give for their number. Where no row has a language, nothing can be
    learnt and all documents with a letter stay.
    """
    model = langid.learn(docs)
    language, known = free_names(docs, "language", "known")
    found = langid.recognise(docs, model, language=language, known=known)
    return found.filter((F.col(language) != langid.UNDETERMINED) & F.col(known)).select(*_columns(docs))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated three-line windows; documents of which nothing is left go.

    ``n_chars``, if there is one, follows the text; other columns stay as they are.
    """
    (was,) = free_names(docs, "was")
    cut = line_dedup.dedup_lines(docs.withColumn(was, F.length("text")))
    left = cut.filter((F.col("text") != "") | F.col("text").isNull() | (F.col(was) == 0))
    if "n_chars" not in docs.columns:
        return left.select(*_columns(docs))
    changed = F.length("text") != F.col(was)
    count = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", count).select(*_columns(docs))


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of near copies."""
    return near_dup.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language", known_language),
    ("line_dedup", unique_lines),
    ("near_duplicates", unique_documents),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

# The knapsack, the line windows with their effect on near duplicates and the language
# model are not expressible together; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
