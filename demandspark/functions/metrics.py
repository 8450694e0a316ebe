"""Forecast accuracy: every metric is one aggregate, so one pass gives all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rmse(actual: Column, predicted: Column) -> Column:
    error = actual - predicted
    return F.sqrt(F.avg(error * error))


def mae(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def mape(actual: Column, predicted: Column) -> Column:
    """Percent; rows with actual = 0 are undefined and left out of the mean."""
    return 100.0 * F.avg(F.abs(F.try_divide(actual - predicted, actual)))


def smape(actual: Column, predicted: Column) -> Column:
    size = F.abs(actual) + F.abs(predicted)
    return 200.0 * F.avg(F.try_divide(F.abs(actual - predicted), size))


def r_squared(actual: Column, predicted: Column) -> Column:
    """1 - SSres/SStot; NULL for a constant actual."""
    error = actual - predicted
    both = error.isNotNull()
    total = F.var_pop(F.when(both, actual)) * F.count(error)
    return 1.0 - F.try_divide(F.sum(error * error), total)


def accuracy(mape_value: Column, clamp: bool = False) -> Column:
    value = 100.0 - mape_value
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)) if clamp else value


def evaluate(
    df: DataFrame,
    by: Sequence[str] = (),
    actual: str = "actual",
    predicted: str = "predicted",
) -> DataFrame:
    """All five metrics per group, with the number of rows MAPE cannot use."""
    a, p = F.col(actual), F.col(predicted)
    return df.groupBy(*by).agg(
        F.count(a - p).alias("n"),
        rmse(a, p).alias("rmse"),
        mae(a, p).alias("mae"),
        mape(a, p).alias("mape"),
        smape(a, p).alias("smape"),
        r_squared(a, p).alias("r_squared"),
        F.count(F.when((a == 0) & p.isNotNull(), 1)).alias("n_undefined"),
    )
