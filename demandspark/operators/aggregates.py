"""Grouped sums over the cleaned fact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.schema import TOTAL


def daily_total(df: DataFrame, keys: Sequence[str] = TOTAL, value: str = "sales_quantity") -> DataFrame:
    """(keys, date, total_sales); NULLs are skipped."""
    return df.groupBy(*keys, "date").agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total_sales")
    )


def structural_shape(daily: DataFrame) -> DataFrame:
    return daily.withColumnsRenamed({"date": "ds", "total_sales": "y"})


def performance(sales: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Quantity and revenue by one dimension key, with its attributes.

    The fact is reduced to one row per key before the join.
    """
    totals = sales.groupBy(key).agg(
        F.sum("sales_quantity").alias("total_sales"),
        F.sum("sales_amount").alias("total_revenue"),
    )
    return totals.join(dimension, key, "left")


def product_performance(sales: DataFrame, products: DataFrame) -> DataFrame:
    return performance(sales, products, "product_id")


def store_performance(sales: DataFrame, stores: DataFrame) -> DataFrame:
    return performance(sales, stores, "store_id")


def sales_kpis(daily: DataFrame) -> DataFrame:
    """One row: grand total and mean of the daily totals."""
    return daily.agg(
        F.sum("total_sales").alias("total_sales"), F.avg("total_sales").alias("avg_daily_sales")
    )


def forecast_kpis(ensemble: DataFrame, horizon: int = 7, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, metric, value) rows: forecast total and daily mean."""
    totals = ensemble.groupBy(*keys).agg(
        F.sum("ensemble_forecast").alias("total"), F.avg("ensemble_forecast").alias("mean")
    )
    return totals.selectExpr(
        *keys,
        f"stack(2, 'Total Forecasted Sales (Next {horizon} Days)', total, "
        f"'Average Daily Sales (Next {horizon} Days)', mean) AS (metric, value)"
    )


def mean_of(values: Column) -> Column:
    """Mean of an array column; NULL when empty."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(values))


def alert_rule(recommendations: DataFrame) -> Column:
    """A product needs reordering when its mean forecast reaches the reorder point."""
    return mean_of(F.col("daily_forecast")) >= F.col("reorder_point")


def alert_count(recommendations: DataFrame) -> DataFrame:
    return recommendations.agg(
        F.count(F.when(alert_rule(recommendations), 1)).alias("inventory_alerts")
    )
