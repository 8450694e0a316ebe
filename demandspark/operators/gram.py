"""Distributed least squares: XtX, Xty and yty summed per series, solved once per series.

Rows are reduced where they lie (one partial per series and Arrow batch), so
what is shuffled is k*k numbers per series, whatever the series' length. Keep
the rows of a series together (any window or repartition by the keys does),
else a batch holds many series with few rows each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTIAL_FIELDS = [
    T.StructField("n", T.LongType()),
    T.StructField("xtx", T.ArrayType(T.DoubleType())),
    T.StructField("xty", T.ArrayType(T.DoubleType())),
    T.StructField("yty", T.DoubleType()),
]


def key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Series hashed over the configured number of shuffle partitions.

    For steps that cost CPU rather than bytes: adaptive coalescing sizes
    partitions by bytes and would pack many small series into a few tasks. A
    later window, join or grouping by the keys reuses this partitioning.
    """
    if not keys:
        return df
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys)


def attach(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One summary row per series onto its rows; without keys a scalar subquery."""
    if keys:
        return df.join(summary, list(keys))
    row = summary.select(F.struct(*summary.columns))
    return df.withColumn("_one", row.scalar()).select("*", "_one.*").drop("_one")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def gram_partials(
    rows: DataFrame, keys: Sequence[str], features: str = "x", target: str = "y"
) -> DataFrame:
    names = list(keys)

    def reduce(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            out = []
            groups = pdf.groupby(names, sort=False, dropna=False) if names else [((), pdf)]
            for key, part in groups:
                x = np.stack(part[features].to_numpy())
                y = part[target].to_numpy(dtype=float)
                out.append((*key, len(y), (x.T @ x).ravel(), x.T @ y, float(y @ y)))
            yield pd.DataFrame(out, columns=[*names, "n", "xtx", "xty", "yty"])

    schema = T.StructType([*key_fields(rows, keys), *PARTIAL_FIELDS])
    return rows.select(*names, features, target).mapInPandas(reduce, schema)


def solve_per_series(
    partials: DataFrame,
    keys: Sequence[str],
    solver: Callable[..., list[tuple]],
    fields: Sequence[T.StructField],
) -> DataFrame:
    """Adds up each series' partials and calls ``solver(key, n, xtx, xty, yty)``."""
    names = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xty = np.sum(np.stack(pdf["xty"].to_numpy()), axis=0)
        xtx = np.sum(np.stack(pdf["xtx"].to_numpy()), axis=0).reshape(len(xty), len(xty))
        key = tuple(pdf[names].iloc[0]) if names else ()
        rows = solver(dict(zip(names, key)), int(pdf["n"].sum()), xtx, xty, float(pdf["yty"].sum()))
        return pd.DataFrame([(*key, *r) for r in rows], columns=[*names, *[f.name for f in fields]])

    schema = T.StructType([*key_fields(partials, keys), *fields])
    return spread(partials, keys).groupBy(*keys).applyInPandas(run, schema)


def least_squares(xtx: np.ndarray, xty: np.ndarray, ridge: np.ndarray | None = None) -> np.ndarray:
    """Normal equations; minimum-norm on rank deficiency, ``ridge`` adds a diagonal.

    A column that is zero up to rounding (a weekly term after weekly
    differencing, say) gets no weight.
    """
    size = np.diag(xtx)
    scale = np.sqrt(np.where(size > 1e-20 * max(size.max(), 1e-300), size, np.inf))
    g = xtx / np.outer(scale, scale)
    if ridge is not None:
        g = g + np.diag(np.where(np.isfinite(scale), ridge / scale**2, 0.0))
    return np.linalg.pinv(g, rcond=1e-10, hermitian=True) @ (xty / scale) / scale


def residual_sum(coef: np.ndarray, xtx: np.ndarray, xty: np.ndarray, yty: float) -> float:
    return max(float(yty - 2.0 * coef @ xty + coef @ xtx @ coef), 0.0)
