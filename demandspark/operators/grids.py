"""Parameter grids as rows, and choosing the best candidate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.schema import ARIMA_RUN_GRID, STRUCTURAL_GRID


# Column names are case-insensitive in Spark, so seasonal orders get long names.
ORDER_COLUMNS = {
    "p": "p", "d": "d", "q": "q", "P": "seasonal_p", "D": "seasonal_d", "Q": "seasonal_q",
}


def with_order_grid(df: DataFrame, limits: Mapping[str, int] = ARIMA_RUN_GRID) -> DataFrame:
    """One row of ``df`` per admissible order, numbered by ``grid_id``.

    ``limits`` are the largest p, d, q, P, D, Q. Orders with p = q = 0 or
    P = Q = 0 are left out. The first name varies fastest, so ``grid_id`` is
    the position in the full product.
    """
    number: Column = F.lit(0)
    step = 1
    for name, column in ORDER_COLUMNS.items():
        df = df.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(limits[name]))))
        number = number + F.col(column) * step
        step *= limits[name] + 1
    return df.withColumn("grid_id", number).filter("p + q > 0 AND seasonal_p + seasonal_q > 0")


def with_value_grid(df: DataFrame, values: Mapping[str, Sequence] = STRUCTURAL_GRID) -> DataFrame:
    """One row of ``df`` per combination; ``grid_id`` counts with the last name fastest."""
    number: Column = F.lit(0)
    for name, options in values.items():
        items = F.array(*[F.lit(x) for x in options])
        df = df.select("*", F.posexplode(items).alias(f"_{name}", name))
        number = number * len(options) + F.col(f"_{name}")
    return df.withColumn("grid_id", number).drop(*[f"_{name}" for name in values])


def best_candidate(
    df: DataFrame, score: str, keys: Sequence[str] = (), order: str = "grid_id"
) -> DataFrame:
    """The row with the smallest score per series; the first candidate wins ties.

    An aggregate, not a sort: candidates are reduced map-side. NULL and NaN
    scores count as infinite.
    """
    value = F.when(F.col(score).isNull() | F.isnan(score), F.lit(float("inf"))).otherwise(F.col(score))
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(value, F.col(order)))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")
