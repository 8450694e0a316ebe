"""Seasonal and trend decomposition by loess (Cleveland et al. 1990), with a periodic season, per series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandspark.operators.gram import key_fields, spread
from demandspark.schema import SEASONAL_PERIOD, TOTAL

LOOPS = 2


def local_line(y: np.ndarray, span: int) -> np.ndarray:
    """Tricube-weighted local lines through the ``span`` nearest of equally spaced points, at each of them."""
    n = len(y)
    width = min(span, n)
    start = np.clip(np.arange(n) - span // 2, 0, n - width)
    at = start[:, None] + np.arange(width)
    distance = np.abs(at - np.arange(n)[:, None])
    # beyond the ends of a short series the window widens
    reach = np.maximum(distance[:, 0], distance[:, -1]) + max(span - n, 0) // 2
    reach = np.maximum(reach, 1)[:, None]
    weight = np.where(distance <= 0.999 * reach, (1 - np.minimum(distance / reach, 1) ** 3) ** 3, 0.0)
    weight[distance <= 0.001 * reach] = 1.0
    weight /= weight.sum(axis=1, keepdims=True)
    x = at.astype(float)
    centre = (weight * x).sum(axis=1)
    spread_ = (weight * (x - centre[:, None]) ** 2).sum(axis=1)
    slope = (weight * (x - centre[:, None]) * y[at]).sum(axis=1)
    tilt = np.where(np.sqrt(spread_) > 0.001 * max(n - 1, 1), slope / np.where(spread_ > 0, spread_, 1.0), 0.0)
    return (weight * y[at]).sum(axis=1) + tilt * (np.arange(n) - centre)


def moving_mean(y: np.ndarray, width: int) -> np.ndarray:
    """Means of all whole windows."""
    total = np.concatenate([[0.0], np.cumsum(y)])
    return (total[width:] - total[:-width]) / width


def _odd(x: float) -> int:
    n = int(np.ceil(x))
    return n + (n % 2 == 0)


def stl(y: np.ndarray, period: int, loops: int = LOOPS) -> tuple[np.ndarray, np.ndarray]:
    """(trend, seasonal) of a series of at least two periods; the season repeats exactly."""
    n = len(y)
    phase = np.arange(n) % period
    size = np.bincount(phase, minlength=period)
    trend, seasonal = np.zeros(n), np.zeros(n)
    # a periodic season is one whose smoothing window is without end
    trend_span, low_span = _odd(1.5 * period / (1 - 1.5 / (10 * n + 1))), _odd(period)
    for _ in range(loops):
        mean = np.bincount(phase, y - trend, period) / size
        # one more period at both ends, so that the moving means cover the series
        cycle = mean[np.arange(-period, n + period) % period]
        low = local_line(moving_mean(moving_mean(moving_mean(cycle, period), period), 3), low_span)
        seasonal = cycle[period: period + n] - low
        trend = local_line(y - seasonal, trend_span)
    seasonal = (np.bincount(phase, seasonal, period) / size)[phase]
    return trend, seasonal


def decompose_loess(
    df: DataFrame, value: str = "total_sales", period: int = SEASONAL_PERIOD, keys: Sequence[str] = TOTAL, index: str = "date",
) -> DataFrame:
    """(keys, index, observed, trend, seasonal, remainder); observed = trend + seasonal + remainder.

    Phases go by row position. A series of less than two periods has its mean as trend and no season.
    Rows without a value are left out. A series meets once in a task, bounded by its days.
    """
    names = [*keys, index, "observed", "trend", "seasonal", "remainder"]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        if pdf[index].duplicated().any():
            raise ValueError(f"series key and {index} do not identify a row: remove or sum copies first")
        y = pdf["_y"].to_numpy(dtype=float)
        if len(y) >= 2 * period:
            trend, seasonal = stl(y, period)
        else:
            trend, seasonal = np.full(len(y), y.mean()), np.zeros(len(y))
        out = {k: [v] * len(y) for k, v in zip(keys, key, strict=True)}
        out |= {index: pdf[index].to_numpy(), "observed": y, "trend": trend, "seasonal": seasonal, "remainder": y - trend - seasonal}
        return pd.DataFrame(out, columns=names)

    schema = T.StructType([*key_fields(df, keys), df.schema[index], *[T.StructField(c, T.DoubleType()) for c in names[-4:]]])
    rows = df.filter(F.col(value).isNotNull()).select(*keys, index, F.col(value).cast("double").alias("_y"))
    return spread(rows, keys).groupBy(*keys).applyInPandas(one, schema)
