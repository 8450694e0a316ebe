"""Display strings for report tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_number(x: Column, decimals: int = 0) -> Column:
    return F.format_number(F.round(x, decimals), decimals)


def format_currency(x: Column, symbol: str = "$", decimals: int = 2) -> Column:
    return F.concat(F.lit(symbol), format_number(x, decimals))


def format_date(d: Column, pattern: str = "MMMM dd, yyyy") -> Column:
    return F.date_format(d, pattern)


def percent_change(new: Column, old: Column, decimals: int = 1) -> Column:
    """Signed change such as '+4.2%'; NULL when the old value is zero."""
    change = F.try_divide(new - old, old) * 100.0
    text = F.format_string(f"%.{decimals}f%%", F.round(change, decimals))
    return F.when(change.isNull(), None).otherwise(
        F.concat(F.when(change >= 0, "+").otherwise(""), text)
    )
