"""The tables of the weekly report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.operators.aggregates import forecast_kpis
from demandspark.operators.ensemble import model_lines
from demandspark.plans.dashboard import (
    forecast_table,
    model_label,
    performance_table,
    recommendation_table,
)
from demandspark.schema import TOTAL


def key_metrics(ensemble: DataFrame, horizon: int = 7, digits: int = 2, keys: Sequence[str] = TOTAL) -> DataFrame:
    return forecast_kpis(ensemble, horizon, keys).withColumn("value", F.round("value", digits))


def forecast_chart(daily: DataFrame, ensemble: DataFrame, keys: Sequence[str] = TOTAL) -> DataFrame:
    """(keys, date, series, value): history and one line per model and the ensemble."""
    history = daily.select(
        *keys, "date", F.lit("Historical").alias("series"), F.col("total_sales").alias("value")
    )
    label = F.when(F.col("model") == "ensemble", "Ensemble").otherwise(model_label(F.col("model")))
    lines = model_lines(ensemble, keys).select(*keys, "date", label.alias("series"), F.col("forecast").alias("value"))
    return history.unionByName(lines)


def product_forecasts(recommendations: DataFrame) -> DataFrame:
    """(product_id, product_name, date, forecast, reorder_point) for every product."""
    points = F.explode(F.arrays_zip("forecast_dates", "daily_forecast"))
    return recommendations.select(
        "product_id", "product_name", points.alias("p"), "reorder_point"
    ).select(
        "product_id",
        "product_name",
        F.col("p.forecast_dates").alias("date"),
        F.col("p.daily_forecast").alias("forecast"),
        "reorder_point",
    )


def product_policy(recommendations: DataFrame, digits: int = 2) -> DataFrame:
    """(product_id, product_name, metric, value): four policy numbers per product."""
    return recommendations.selectExpr(
        "product_id",
        "product_name",
        "stack(4, 'Safety Stock', safety_stock, 'Reorder Point', reorder_point, "
        "'Economic Order Quantity', economic_order_quantity, "
        "'Recommended Order Quantity', recommended_order_quantity) AS (metric, value)",
    ).withColumn("value", F.round("value", digits))


def build_report_tables(tables: Mapping[str, DataFrame], horizon: int = 7, keys: Sequence[str] = TOTAL) -> dict[str, DataFrame]:
    """All report sections from the stage tables, of the total or with a row set for every key.

    Tables: ensemble, metrics, recommendations, and the history, ``series`` for keys and ``daily`` for the total.
    """
    history = tables["series"] if keys else tables["daily"]
    return {
        "key_metrics": key_metrics(tables["ensemble"], horizon, keys=keys),
        "forecast_chart": forecast_chart(history, tables["ensemble"], keys),
        "forecast_table": forecast_table(tables["ensemble"], keys=keys),
        "model_performance": performance_table(tables["metrics"], keys=keys).drop("accuracy"),
        "inventory_recommendations": recommendation_table(tables["recommendations"]),
        "product_forecasts": product_forecasts(tables["recommendations"]),
        "product_policy": product_policy(tables["recommendations"]),
    }
