"""Sequence-to-one regression on the last values, pooled over all series.

Each series is standardised, cut into windows of ``length`` values with the
next value as label, and one regressor is trained on the windows of all
series. Forecasts feed predictions back. The regressor is linear, a gradient-boosted
tree ensemble or a network of two recurrent layers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.functions.metrics import evaluate
from demandspark.operators import recurrent
from demandspark.operators.ensemble import with_band
from demandspark.operators.gram import attach, dot
from demandspark.operators.panel import (
    chronological_split,
    denormalise,
    holdout_split,
    last_rows,
    normalisation,
    sequence_windows,
    series_window,
    standardise,
)
from demandspark.schema import (
    BAND,
    HOLDOUT_DAYS,
    HORIZON,
    SEQUENCE_LENGTH,
    TOTAL,
    TRAIN_FRACTION,
)

MODEL = "lstm"


@dataclass(frozen=True)
class SequenceModel:
    """A trained pooled regressor, its error table and each series' normalisation.

    A recurrent network also has the errors of each epoch as ``history``.
    """

    kind: str
    length: int
    keys: tuple[str, ...]
    regressor: Any
    errors: DataFrame
    scaling: DataFrame
    history: DataFrame | None = None


def training_windows(
    series: DataFrame, keys: Sequence[str] = TOTAL, length: int = SEQUENCE_LENGTH,
    fraction: float = TRAIN_FRACTION, value: str = "total_sales",
) -> DataFrame:
    """(keys, date, sequence, label, split) in standardised units.

    Series without variation cannot be standardised and teach nothing; their forecast is
    their value.
    """
    scaled = standardise(series, value, keys).filter("normalised IS NOT NULL")
    return chronological_split(sequence_windows(scaled, "normalised", length, keys), fraction, keys)


def train(
    series: DataFrame,
    keys: Sequence[str] = TOTAL,
    length: int = SEQUENCE_LENGTH,
    kind: str = "linear",
    fraction: float = TRAIN_FRACTION,
    value: str = "total_sales",
    seed: int = 7,
    **options,
) -> SequenceModel:
    """Trains on the first ``fraction`` of each series' windows.

    ``errors`` holds mean squared and absolute error per split, the numbers a
    training history ends with. ``kind`` is ``linear``, ``trees`` or ``recurrent``
    (options: ``units``, ``epochs``, ``rate``, ``dropout``).
    """
    if kind == "recurrent":
        windows = training_windows(series, keys, length, fraction, value)
        network, errors, history = recurrent.fit(windows, [*keys, "date"], length, seed=seed, **options)
        return SequenceModel(
            kind, length, tuple(keys), network, errors, normalisation(series, value, keys), history)
    if kind == "linear":
        estimator = LinearRegression(
            featuresCol="features", labelCol="label", solver="normal", **options)
    elif kind == "trees":
        estimator = GBTRegressor(
            featuresCol="features", labelCol="label", seed=seed,
            **{"maxIter": 20, "maxDepth": 4, **options})
    else:
        raise ValueError("kind is 'linear', 'trees' or 'recurrent'")
    windows = training_windows(series, keys, length, fraction, value).withColumn(
        "features", array_to_vector("sequence")
    )
    # the trainer reads its input several times
    known = windows.filter("split = 'train'").select("features", "label").persist()
    regressor = estimator.fit(known)
    known.unpersist()
    miss = F.col("label") - F.col("prediction")
    errors = regressor.transform(windows).groupBy("split").agg(
        F.count("*").alias("n"), F.avg(miss * miss).alias("mse"), F.avg(F.abs(miss)).alias("mae")
    )
    return SequenceModel(
        kind, length, tuple(keys), regressor, errors, normalisation(series, value, keys))


def _linear_path(model: SequenceModel, horizon: int) -> Column:
    """Array of ``horizon`` predictions from the ``state`` array, without a UDF."""
    weights = F.array(*[F.lit(float(c)) for c in model.regressor.coefficients])
    base = F.lit(float(model.regressor.intercept))

    def step(values: Column, _i: Column) -> Column:
        # the last ``length`` numbers are the current window
        window = F.slice(values, F.size(values) - model.length + 1, model.length)
        return F.concat(values, F.array(base + dot(weights, window)))

    grown = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("state"), step)
    return F.slice(grown, model.length + 1, horizon)


def forecast(
    model: SequenceModel,
    series: DataFrame,
    horizon: int = HORIZON,
    value: str = "total_sales",
    band_pct: float = BAND,
) -> DataFrame:
    """(keys, model, step, date, yhat, lower, upper) for the days after each series."""
    keys = model.keys
    points = F.sort_array(F.collect_list(F.struct("date", F.col(value).alias("v"))))
    tail = last_rows(series.select(*keys, "date", value), model.length, keys).groupBy(*keys).agg(
        points.alias("_p"), F.max("date").alias("_last")
    )
    mean, sd = F.col("mean"), F.col("sd")
    # a constant series stays at its mean; a short one is filled up in front with its mean
    unit = F.when(sd > 0, sd).otherwise(F.lit(1.0))
    known = F.transform(F.col("_p.v"), lambda v: (v - mean) / unit)
    missing = F.array_repeat(F.lit(0.0), F.lit(model.length) - F.size("_p"))
    start = attach(tail, model.scaling, keys).withColumn("state", F.concat(missing, known))
    if model.kind == "linear":
        path = start.withColumn("_path", _linear_path(model, horizon))
    elif model.kind == "recurrent":
        path = recurrent.with_path(start, model.regressor, horizon)
    else:
        # one transform per step on one row per series
        path = start
        for _ in range(horizon):
            window = F.slice("state", F.size("state") - model.length + 1, model.length)
            path = model.regressor.transform(path.withColumn("features", array_to_vector(window)))
            path = path.withColumn("state", F.concat("state", F.array("prediction"))).drop(
                "features", "prediction")
        path = path.withColumn("_path", F.slice("state", model.length + 1, horizon))
    steps = path.select(*keys, "_last", "mean", "sd", F.posexplode("_path").alias("_i", "_z"))
    raw = steps.select(
        *keys,
        F.lit(MODEL).alias("model"),
        (F.col("_i") + 1).alias("step"),
        F.expr("date_add(_last, _i + 1)").alias("date"),
        F.when(sd > 0, denormalise(F.col("_z"), mean, sd)).otherwise(mean).alias("yhat"),
    )
    return with_band(raw, "yhat", band_pct)


def evaluate_holdout(
    series: DataFrame, keys: Sequence[str] = TOTAL, days: int = HOLDOUT_DAYS, **options
) -> tuple[DataFrame, DataFrame]:
    """(scored rows, metrics per series); the k-th test row meets the k-th step."""
    split = holdout_split(series, days, keys)
    known = split.filter("split = 'train'").drop("split")
    model = train(known, keys, **options)
    ahead = forecast(model, known, days + 1)
    test = split.filter("split = 'test'").select(
        *keys, "date", F.col("total_sales").alias("actual"),
        F.row_number().over(series_window(keys)).alias("step"),
    )
    scored = ahead.drop("date").join(test, [*keys, "step"]).select(
        *keys, "model", "date", "actual", F.col("yhat").alias("predicted")
    )
    return scored, evaluate(scored, [*keys, "model"])


def run(
    series: DataFrame,
    keys: Sequence[str] = TOTAL,
    horizon: int = HORIZON,
    evaluate_model: bool = True,
    **options,
) -> dict[str, DataFrame]:
    """Training errors, forecast and holdout tables."""
    model = train(series, keys, **options)
    out = {"errors": model.errors, "forecast": forecast(model, series, horizon).drop("step")}
    if model.history is not None:
        out["history"] = model.history
    if evaluate_model:
        out["holdout"], out["metrics"] = evaluate_holdout(series, keys, **options)
    return out
