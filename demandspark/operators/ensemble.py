"""Combining the forecasts of several models.

Forecasts travel in long form: (keys..., model, date, yhat[, lower, upper]).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandspark.schema import BAND, ENSEMBLE_WEIGHTS, HORIZON, MODELS, TOTAL


def first_future_values(
    forecasts: DataFrame,
    history: DataFrame,
    horizon: int = HORIZON,
    keys: Sequence[str] = TOTAL,
) -> DataFrame:
    """The first ``horizon`` rows per model after each series' last history date."""
    last = history.groupBy(*keys).agg(F.max("date").alias("_last"))
    if keys:
        joined = forecasts.join(last, list(keys))
    else:
        joined = forecasts.withColumn("_last", last.scalar())
    w = Window.partitionBy(*keys, "model").orderBy("date")
    return (
        joined.filter(F.col("date") > F.col("_last"))
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= horizon)
        .drop("_rn", "_last")
    )


def ensemble_frame(forecasts: DataFrame, keys: Sequence[str] = TOTAL) -> DataFrame:
    """(keys, date, <model>_forecast..., ensemble_forecast): simple mean of the models.

    Models are aligned by (keys, date) in one aggregation; a date that lacks a
    model has a NULL ensemble value.
    """
    wide = forecasts.groupBy(*keys, "date").agg(
        *[F.max(F.when(F.col("model") == m, F.col("yhat"))).alias(f"{m}_forecast") for m in MODELS]
    )
    total = sum((F.col(f"{m}_forecast") for m in MODELS[1:]), F.col(f"{MODELS[0]}_forecast"))
    return wide.withColumn("ensemble_forecast", total / float(len(MODELS)))


def weighted_ensemble(
    forecasts: DataFrame,
    weights: Mapping[str, float] = ENSEMBLE_WEIGHTS,
    keys: Sequence[str] = TOTAL,
    tolerance: float = 1e-3,
) -> DataFrame:
    """Weighted mean; weights are normalised when they do not sum to 1."""
    size = sum(weights.values())
    scale = size if abs(size - 1.0) > tolerance else 1.0
    parts = [
        F.max(F.when(F.col("model") == m, F.col("yhat"))) * F.lit(w / scale)
        for m, w in weights.items()
    ]
    total = sum(parts[1:], parts[0])
    return forecasts.groupBy(*keys, "date").agg(total.alias("ensemble_forecast"))


def model_lines(ensemble: DataFrame, keys: Sequence[str] = TOTAL) -> DataFrame:
    """The ensemble frame back in long form, one ``model`` per line."""
    names = (*MODELS, "ensemble")
    pairs = ", ".join(f"'{m}', {m}_forecast" for m in names)
    return ensemble.selectExpr(*keys, "date", f"stack({len(names)}, {pairs}) AS (model, forecast)")


def with_band(df: DataFrame, value: str = "forecast", band_pct: float = BAND) -> DataFrame:
    """A symmetric percentage band, not a confidence interval."""
    return df.withColumns(
        {
            "lower": F.col(value) * (1.0 - band_pct),
            "upper": F.col(value) * (1.0 + band_pct),
        }
    )
