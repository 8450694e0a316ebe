"""Feature engineering over the cleaned tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from demandspark.functions.calendar import Holidays, with_date_flag, with_date_parts
from demandspark.operators.aggregates import daily_total, structural_shape
from demandspark.operators.panel import with_lags, with_trailing_means
from demandspark.schema import FEATURE_HOLIDAYS, SERIES_KEYS, TOTAL


def time_features(sales: DataFrame, holidays: Holidays = FEATURE_HOLIDAYS) -> DataFrame:
    return with_date_flag(with_date_parts(sales), holidays, "is_holiday")


def lag_features(sales: DataFrame, keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """Lags 1 and 7 and trailing means 7 and 14: one shuffle and one sort for all four."""
    with_lag = with_lags(sales, "sales_quantity", (1, 7), keys, prefix="sales_lag")
    return with_trailing_means(with_lag, "sales_quantity", (7, 14), keys, prefix="sales_ma")


def model_tables(sales: DataFrame, keys: Sequence[str] = TOTAL) -> dict[str, DataFrame]:
    """The three model inputs share one daily aggregate."""
    daily = daily_total(sales, keys)
    return {"arima_data": daily, "prophet_data": structural_shape(daily), "lstm_data": daily}


def engineer_features(
    cleaned: Mapping[str, DataFrame],
    holidays: Holidays = FEATURE_HOLIDAYS,
    keys: Sequence[str] = TOTAL,
) -> dict[str, DataFrame]:
    """``full_features``, the model inputs and the cleaned tables, all lazy.

    The daily total needs none of the features, so it reads the cleaned fact
    and does not wait for the windows.
    """
    return {
        "full_features": lag_features(time_features(cleaned["sales"], holidays)),
        **model_tables(cleaned["sales"], keys),
        **cleaned,
    }
