"""Stage tables: Parquet folders written by one step and read by the next.

Every write makes a new version of a table in a folder of its own; a small file names the current
one and is replaced in one step once the version is complete. A step that fails or is repeated
thus never leaves half a table, and readers of the version before keep their files until
the write after next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = {"sales": "date", "features": "date"}
CURRENT = "_current"
_PREFIX = "version-"


def stage_path(base: str, table: str) -> str:
    return f"{base.rstrip('/')}/{table}"


def _files(spark: SparkSession, path: str):
    """(file system, path) of any Hadoop file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def current_version(spark: SparkSession, base: str, table: str) -> str | None:
    """Path of the last complete version, None if there is none."""
    fs, at = _files(spark, f"{stage_path(base, table)}/{CURRENT}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        name = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return f"{stage_path(base, table)}/{name}"


def _publish(spark: SparkSession, base: str, table: str, version: str) -> None:
    """Makes ``version`` the current one in one rename, then drops all but it and the one before."""
    jvm, root = spark.sparkContext._jvm, stage_path(base, table)
    before = current_version(spark, base, table)
    fs, draft = _files(spark, f"{root}/{CURRENT}-{uuid.uuid4().hex}")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()
    _, target = _files(spark, f"{root}/{CURRENT}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(draft, target, options)
    kept = {version, before.rsplit("/", 1)[1] if before else version}
    for status in fs.listStatus(_files(spark, root)[1]):
        name = status.getPath().getName()
        if name.startswith(_PREFIX) and name not in kept:
            fs.delete(status.getPath(), True)


def write_stage(df: DataFrame, base: str, table: str, month_of: str | None = None) -> None:
    """A new version of one stage table; ``month_of`` partitions a fact by year-month.

    Until the whole version is there, readers get the one before.
    """
    version = f"{_PREFIX}{uuid.uuid4().hex}"
    path = f"{stage_path(base, table)}/{version}"
    if month_of:
        # cluster by month first: a few files per month, not one per task and
        # month; AQE splits a month that is larger than the advisory size
        df = df.withColumn("year_month", F.date_format(month_of, "yyyy-MM"))
        df.hint("rebalance", "year_month").write.partitionBy("year_month").parquet(path)
    else:
        df.write.parquet(path)
    _publish(df.sparkSession, base, table, version)


def read_stage(
    spark: SparkSession, base: str, table: str,
    first: date | None = None, last: date | None = None, month_of: str = "date",
) -> DataFrame:
    """One stage table; of a fact, with ``first`` or ``last``, only those dates and their months.

    The bounds become filters on the partition column too, so other months are not listed.
    """
    path = current_version(spark, base, table)
    if path is None:
        raise FileNotFoundError(f"no stage table {table} under {base}")
    df = spark.read.parquet(path)
    for bound, least in ((first, True), (last, False)):
        if bound is None:
            continue
        day, month = F.col(month_of), bound.strftime("%Y-%m")
        df = df.filter(day >= bound if least else day <= bound)
        if "year_month" in df.columns:
            df = df.filter(F.col("year_month") >= month if least else F.col("year_month") <= month)
    return df.drop("year_month") if "year_month" in df.columns else df


def stage_exists(spark: SparkSession, base: str, table: str) -> bool:
    """True when a version of the table was written completely (any Hadoop file system)."""
    return current_version(spark, base, table) is not None


def stages_available(spark: SparkSession, base: str, tables: Iterable[str]) -> bool:
    return all(stage_exists(spark, base, t) for t in tables)


def load_all(
    spark: SparkSession,
    base: str,
    tables: Iterable[str],
    build: Callable[[], Mapping[str, DataFrame]] | None = None,
) -> dict[str, DataFrame]:
    """Read every stage table; if any is missing run ``build`` first."""
    tables = list(tables)
    if not stages_available(spark, base, tables):
        if build is None:
            missing = [t for t in tables if not stage_exists(spark, base, t)]
            raise FileNotFoundError(f"stage tables missing under {base}: {missing}")
        for name, df in build().items():
            write_stage(df, base, name, FACTS.get(name))
    return {t: read_stage(spark, base, t) for t in tables}
