"""Database query source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(
    url: str,
    query: str | None = None,
    table: str | None = None,
    partition_column: str | None = None,
    lower_bound: str | int | None = None,
    upper_bound: str | int | None = None,
    num_partitions: int | None = None,
    fetch_size: int = 10_000,
    **extra: str,
) -> dict[str, str]:
    """Reader options. A plain ``query`` is read by one task.

    For large tables give ``table`` (or a query in brackets with an alias)
    and all four partition arguments: Spark then reads ranges in parallel.
    """
    if (query is None) == (table is None):
        raise ValueError("give either query or table")
    options = {"url": url, "fetchsize": str(fetch_size), **extra}
    options["query" if query else "dbtable"] = query or table
    split = (partition_column, lower_bound, upper_bound, num_partitions)
    if any(x is not None for x in split):
        if query or any(x is None for x in split):
            raise ValueError("a parallel read needs table and all four partition arguments")
        names = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")
        options.update({k: str(v) for k, v in zip(names, split)})
    return options


def load_query(spark: SparkSession, url: str, query: str | None = None, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, query, **options)).load()
