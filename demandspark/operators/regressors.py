"""Regressor frames: the same column functions serve history, test and future dates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandspark.functions.calendar import (
    Holidays,
    is_weekend,
    with_date_flag,
    with_fourier_terms,
    with_holiday_flags,
    with_month_dummies,
    with_weekday_dummies,
)
from demandspark.operators.panel import (
    drop_incomplete_lag,
    future_dates,
    with_lags,
    with_row_sequence,
)
from demandspark.schema import DESIGN_COLUMNS, HORIZON, MODEL_HOLIDAYS, SPECIAL_EVENTS, TOTAL

EXOGENOUS = ("temperature", "price_index", "promotion")


def calendar_regressors(
    df: DataFrame, holidays: Holidays = MODEL_HOLIDAYS, date_col: str = "date"
) -> DataFrame:
    df = with_weekday_dummies(df, date_col)
    df = with_fourier_terms(with_month_dummies(df, date_col), date_col)
    return with_holiday_flags(df, holidays, date_col)


def external_regressors(
    series: DataFrame,
    holidays: Holidays = MODEL_HOLIDAYS,
    keys: Sequence[str] = TOTAL,
    drop_incomplete: bool = True,
) -> DataFrame:
    """Calendar regressors and lags 1, 7, 30 of ``total_sales``.

    ``drop_incomplete`` removes the first 30 rows of each series, whose
    longest lag is unknown.
    """
    df = with_lags(calendar_regressors(series, holidays), "total_sales", (1, 7, 30), keys)
    return drop_incomplete_lag(df) if drop_incomplete else df


def design_matrix(df: DataFrame, columns: Sequence[str] = DESIGN_COLUMNS, name: str = "xreg") -> DataFrame:
    """Adds one ``array<double>`` with the design columns in fixed order."""
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in columns]))


def future_regressors(
    series: DataFrame,
    horizon: int = HORIZON,
    holidays: Holidays = MODEL_HOLIDAYS,
    keys: Sequence[str] = TOTAL,
) -> DataFrame:
    """Calendar regressors for the ``horizon`` days after each series."""
    return calendar_regressors(future_dates(series, horizon, keys), holidays)


def seasonal_temperature(d: Column) -> Column:
    """Yearly wave of 5 degrees, in phase with 1 January 2020."""
    days = F.datediff(d, F.lit("2020-01-01").cast("date"))
    return 5.0 * F.sin(2.0 * math.pi * days / 365.0)


def _uniform(d: Column, seed: int, stream: int) -> Column:
    """Repeatable value in (0, 1) per date: equal on every executor and rerun."""
    return (F.pmod(F.xxhash64(d, F.lit(seed), F.lit(stream)), F.lit(1_000_003)) + 0.5) / 1_000_003.0


def demo_exogenous(dates: DataFrame, seed: int = 123) -> DataFrame:
    """(date, temperature, price_index, promotion): stand-in where no table is given.

    One row per date: the price walk orders dates of a calendar, not of a fact.
    """
    d = F.col("date")

    def normal(stream: int) -> Column:
        radius = F.sqrt(-2.0 * F.ln(_uniform(d, seed, stream)))
        return radius * F.cos(2.0 * math.pi * _uniform(d, seed, stream + 1))

    walk = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return dates.select("date").distinct().select(
        "date",
        (20.0 + 5.0 * normal(0) + seasonal_temperature(d)).alias("temperature"),
        (100.0 + F.sum(0.1 * normal(2)).over(walk)).alias("price_index"),
        (_uniform(d, seed, 4) < 0.1).cast("double").alias("promotion"),
    )


def structural_regressors(
    series: DataFrame,
    exogenous: DataFrame,
    events: Holidays = SPECIAL_EVENTS,
    keys: Sequence[str] = TOTAL,
) -> DataFrame:
    """Adds exogenous columns by date, calendar columns, event flag and running day.

    ``exogenous`` holds one row per date; dates it lacks keep NULL.
    """
    d = F.col("date")
    df = series.join(exogenous.select("date", *EXOGENOUS), "date", "left").withColumns(
        {
            "day_of_week": F.dayofweek(d),
            "is_weekend": is_weekend(d).cast("double"),
            "month": F.month(d),
            "quarter": F.quarter(d),
        }
    )
    return with_row_sequence(with_date_flag(df, events, "special_event"), keys)


def with_exogenous(
    df: DataFrame, exogenous: DataFrame, events: Holidays = SPECIAL_EVENTS
) -> DataFrame:
    """Adds the regressor columns by date, filled where the table has no value.

    Missing values become: temperature 20 plus the yearly wave, price the last
    known value of the table, promotion none.
    """
    d = F.col("date")
    last_price = exogenous.agg(F.max_by("price_index", F.when(F.col("price_index").isNotNull(), d)))
    df = df.join(exogenous.select("date", *EXOGENOUS), "date", "left").withColumns(
        {
            "temperature": F.coalesce("temperature", 20.0 + seasonal_temperature(d)),
            "price_index": F.coalesce(F.col("price_index"), last_price.scalar()),
            "promotion": F.coalesce("promotion", F.lit(0.0)),
            "is_weekend": is_weekend(d).cast("double"),
        }
    )
    return with_date_flag(df, events, "special_event")


def future_exogenous(
    series: DataFrame,
    exogenous: DataFrame,
    horizon: int = HORIZON,
    events: Holidays = SPECIAL_EVENTS,
    keys: Sequence[str] = TOTAL,
) -> DataFrame:
    """Regressors for the days after each series; known future values are used."""
    return with_exogenous(future_dates(series, horizon, keys), exogenous, events)
