"""Calendar features: pure column expressions, so they cost no shuffle."""

from __future__ import annotations

import math
from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEKDAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]

Holidays = Iterable[date] | DataFrame


def to_date_safe(col: Column) -> Column:
    """Date cast that gives NULL for bad input instead of failing the job."""
    return col.try_cast("date")


def weekday_number(d: Column) -> Column:
    """1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(d)


def weekday_label(d: Column) -> Column:
    return F.date_format(d, "E")


def is_weekend(d: Column) -> Column:
    return F.dayofweek(d).isin(1, 7).cast("int")


def with_date_parts(df: DataFrame, date_col: str = "date") -> DataFrame:
    d = F.col(date_col)
    return df.withColumns(
        {
            "year": F.year(d),
            "month": F.month(d),
            "day": F.dayofmonth(d),
            "day_of_week": weekday_label(d),
            "week_of_year": F.weekofyear(d),
            "is_weekend": is_weekend(d),
            "quarter": F.quarter(d),
        }
    )


def with_date_flag(
    df: DataFrame,
    dates: Holidays,
    name: str,
    date_col: str = "date",
    shift: int = 0,
) -> DataFrame:
    """1.0 where ``date_col`` is one of ``dates`` moved by ``shift`` days, else 0.0.

    A Python list becomes an ``IN`` list (no join). A calendar table (column
    ``date``) becomes a left join; Catalyst broadcasts it only while its
    measured size allows, and falls back to a shuffled join beyond that.
    """
    if not isinstance(dates, DataFrame):
        moved = [x + timedelta(days=shift) for x in dates]
        flag = F.col(date_col).isin(moved) if moved else F.lit(False)
        return df.withColumn(name, F.coalesce(flag, F.lit(False)).cast("double"))
    marks = (
        dates.select(F.date_add(F.col("date"), shift).alias(date_col))
        .distinct()
        .withColumn(name, F.lit(1.0))
    )
    return df.join(marks, date_col, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))


def with_holiday_flags(df: DataFrame, holidays: Holidays, date_col: str = "date") -> DataFrame:
    """On-the-day, day-before and day-after holiday flags."""
    if not isinstance(holidays, DataFrame):
        holidays = list(holidays)
    df = with_date_flag(df, holidays, "is_holiday", date_col)
    df = with_date_flag(df, holidays, "is_day_before_holiday", date_col, -1)
    return with_date_flag(df, holidays, "is_day_after_holiday", date_col, 1)


def expand_holiday_windows(holidays: DataFrame) -> DataFrame:
    """(holiday, ds, lower_window, upper_window) -> one row per covered day."""
    return holidays.select(
        "holiday",
        F.col("ds").alias("holiday_date"),
        F.explode(F.sequence(F.col("lower_window"), F.col("upper_window"))).alias("offset"),
    ).withColumn("ds", F.expr("date_add(holiday_date, offset)"))


def with_weekday_dummies(df: DataFrame, date_col: str = "date") -> DataFrame:
    dow = F.dayofweek(F.col(date_col))
    return df.withColumns(
        {f"is_{name}": (dow == number).cast("double") for number, name in enumerate(WEEKDAYS, 1)}
    )


def with_month_dummies(df: DataFrame, date_col: str = "date") -> DataFrame:
    month = F.month(F.col(date_col))
    cols = {f"is_month_{m}": (month == m).cast("double") for m in range(1, 13)}
    return df.withColumns({"month": month, **cols})


def fourier_pair(d: Column, period: float, order: int) -> tuple[Column, Column]:
    """sin and cos of 2*pi*order*epoch_day/period."""
    angle = F.unix_date(d) * F.lit(2.0 * math.pi * order) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def with_fourier_terms(df: DataFrame, date_col: str = "date") -> DataFrame:
    d = F.col(date_col)
    weekly = [term for order in (1, 2) for term in fourier_pair(d, 7, order)]
    monthly = list(fourier_pair(d, 30.44, 1))
    return df.withColumns(
        {
            **{f"fourier_w{i}": c for i, c in enumerate(weekly, 1)},
            **{f"fourier_m{i}": c for i, c in enumerate(monthly, 1)},
        }
    )


def report_range(period: Column, end_date: Column) -> tuple[Column, Column]:
    """(start, end) for a named report period; unknown names mean weekly.

    Month arithmetic clamps to the last day of a shorter month.
    """
    start = (
        F.when(period == "daily", F.date_sub(end_date, 1))
        .when(period == "monthly", F.add_months(end_date, -1))
        .when(period == "quarterly", F.add_months(end_date, -3))
        .when(period == "yearly", F.add_months(end_date, -12))
        .otherwise(F.date_sub(end_date, 7))
    )
    return start, end_date
