"""Helpers that the operators share: tables in the shared folder, text splitting, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.session import shared_folder

LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the folder all executors share and reads it back.

    Later steps then restart from these files when an executor is lost, and the work
    is not repeated by each of them. The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


BATCH_ROWS = 512


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches kept to at most BATCH_ROWS rows.

    The default of 10,000 rows is for short rows; whole texts would fill a Python worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as make it no column of ``df``, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def lower_words(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").translate(LOWER_ASCII).split() if text else []


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for every node.

    Alternates large-star and small-star: every node points to the smallest neighbour it
    knows until only stars are left, a number of rounds logarithmic in the component. A hub
    is never gathered: its neighbours meet it in a join that the adaptive plan can split.
    Without edges the result is empty.
    """
    links = stage(edges.filter("a <> b").select("a", "b").distinct(), name)
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # large star: larger neighbours move to the smallest one
        large = (
            both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b").distinct()
        )
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").filter("a <> b").distinct()
        )
        links = stage(small, name)
        # done once no source has two targets or is itself a target: a forest of stars
        role = links.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
            links.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        role = role.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if role.filter("out > 1 OR (out = 1 AND into = 1)").agg(F.count("*")).first()[0] == 0:
            break
    own = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return own.unionByName(own.select(F.col("component").alias("node"), "component").distinct())
