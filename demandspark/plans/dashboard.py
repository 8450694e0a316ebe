"""The table behind each dashboard panel."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.functions.metrics import accuracy
from demandspark.operators.aggregates import alert_count, daily_total, sales_kpis
from demandspark.operators.diagnostics import (
    decompose,
    histogram,
    qq_points,
    residual_series,
)
from demandspark.operators.ensemble import model_lines, with_band
from demandspark.operators.loess import decompose_loess
from demandspark.schema import MODELS

ALL = "all"
MODEL_LABELS = {"arima": "ARIMA", "prophet": "Prophet", "lstm": "LSTM"}


def model_label(model: Column) -> Column:
    label = F
    for name, text in MODEL_LABELS.items():
        label = label.when(model == name, text)
    return label.otherwise(model)


def kpi_row(daily: DataFrame, metrics: DataFrame, recommendations: DataFrame) -> DataFrame:
    """One row: totals, forecast accuracy of the first model, number of alerts."""
    mape = metrics.filter(F.col("model") == MODELS[0]).agg(F.max("mape"))
    alerts = alert_count(recommendations)
    return (
        sales_kpis(daily)
        .withColumn("forecast_accuracy", accuracy(mape.scalar(), clamp=True))
        .withColumn("inventory_alerts", alerts.scalar())
    )


def filter_choices(dimension: DataFrame, id_col: str, name_col: str, all_label: str) -> DataFrame:
    """(label, value): 'name (id)' for each member and one row for no filter."""
    members = dimension.select(
        F.concat(F.col(name_col), F.lit(" ("), F.col(id_col), F.lit(")")).alias("label"),
        F.col(id_col).alias("value"),
    )
    everything = dimension.sparkSession.createDataFrame([(all_label, ALL)], "label string, value string")
    return everything.unionByName(members)


def filter_sales(
    sales: DataFrame,
    start: date | str | None = None,
    end: date | str | None = None,
    product: str = ALL,
    store: str = ALL,
) -> DataFrame:
    """Panel filters, applied to the fact so that they reach the scan."""
    if start is not None:
        sales = sales.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        sales = sales.filter(F.col("date") <= F.lit(end).cast("date"))
    if product != ALL:
        sales = sales.filter(F.col("product_id") == product)
    if store != ALL:
        sales = sales.filter(F.col("store_id") == store)
    return sales


def sales_trend(sales: DataFrame, ensemble: DataFrame, **filters) -> DataFrame:
    """(date, series, value): filtered history and the ensemble forecast."""
    history = daily_total(filter_sales(sales, **filters)).select(
        "date", F.lit("Historical Sales").alias("series"), F.col("total_sales").alias("value")
    )
    future = ensemble.select(
        "date", F.lit("Forecast").alias("series"), F.col("ensemble_forecast").alias("value")
    )
    return history.unionByName(future)


def demo_stock(recommendations: DataFrame, seed: int = 1) -> DataFrame:
    """Repeatable stand-in stock between 0 and twice the reorder point."""
    draw = F.pmod(F.xxhash64("product_id", F.lit(seed)), F.lit(10_001)) / 10_000.0
    return recommendations.select(
        "product_id", F.round(draw * 2.0 * F.col("reorder_point")).alias("current_stock")
    )


def inventory_status(recommendations: DataFrame, stock: DataFrame) -> DataFrame:
    """Critical up to the safety stock, Reorder up to the reorder point, else OK."""
    level = F.col("current_stock")
    status = (
        F.when(level <= F.col("safety_stock"), "Critical")
        .when(level <= F.col("reorder_point"), "Reorder")
        .when(level.isNotNull(), "OK")
    )
    return recommendations.join(stock, "product_id", "left").select(
        F.col("product_name").alias("product"),
        "product_id",
        "current_stock",
        F.round("reorder_point").alias("reorder_point"),
        status.alias("status"),
    )


def model_forecast(ensemble: DataFrame, model: str = "ensemble", band_pct: float = 0.1) -> DataFrame:
    """(date, forecast, lower, upper) of one model; unknown names mean the ensemble."""
    column = f"{model}_forecast" if model in MODELS else "ensemble_forecast"
    return with_band(ensemble.select("date", F.col(column).alias("forecast")), "forecast", band_pct)


def forecast_table(ensemble: DataFrame, digits: int = 2, keys: Sequence[str] = ()) -> DataFrame:
    return ensemble.select(
        *keys,
        "date",
        *[F.round(f"{m}_forecast", digits).alias(m) for m in (*MODELS, "ensemble")],
    )


def decomposition(daily: DataFrame, period: int = 7, method: str = "classical") -> DataFrame:
    """``classical`` moving means in Spark functions, or ``loess`` with a periodic season."""
    if method == "loess":
        return decompose_loess(daily, "total_sales", period)
    return decompose(daily, "total_sales", period)


def recommendation_table(recommendations: DataFrame, digits: int = 2) -> DataFrame:
    return recommendations.select(
        "product_id",
        "product_name",
        F.round("safety_stock", digits).alias("safety_stock"),
        F.round("reorder_point", digits).alias("reorder_point"),
        F.round("recommended_order_quantity", digits).alias("recommended_order_quantity"),
        "lead_time_days",
    )


def planning_lines(recommendations: DataFrame, product: str = ALL) -> DataFrame:
    """Forecast with both stock levels for one product, else for the first one."""
    chosen = F.col("product_id") == product
    pick = recommendations.agg(
        F.coalesce(F.max(F.when(chosen, F.col("product_id"))), F.min("product_id"))
    )
    points = F.explode(F.arrays_zip("forecast_dates", "daily_forecast"))
    return (
        recommendations.filter(F.col("product_id") == pick.scalar())
        .select("product_id", "product_name", points.alias("p"), "reorder_point", "safety_stock")
        .select(
            "product_id",
            "product_name",
            F.col("p.forecast_dates").alias("date"),
            F.col("p.daily_forecast").alias("forecast"),
            "reorder_point",
            "safety_stock",
        )
    )


def safety_stock_by_lead_time(recommendations: DataFrame) -> DataFrame:
    return recommendations.select(
        F.col("product_name").alias("product"),
        "product_id",
        "safety_stock",
        F.col("lead_time_days").alias("lead_time"),
    )


def order_quantities(recommendations: DataFrame) -> DataFrame:
    """(product, product_id, measure, quantity)."""
    return recommendations.selectExpr(
        "product_name AS product",
        "product_id",
        "stack(3, 'EOQ', economic_order_quantity, 'MOQ', CAST(min_order_quantity AS DOUBLE), "
        "'Recommended', recommended_order_quantity) AS (measure, quantity)",
    )


def model_comparison(metrics: DataFrame) -> DataFrame:
    """(model, metric, value) for the grouped bars."""
    return metrics.select(model_label(F.col("model")).alias("model"), "rmse", "mae", "mape").selectExpr(
        "model", "stack(3, 'RMSE', rmse, 'MAE', mae, 'MAPE', mape) AS (metric, value)"
    )


def performance_table(metrics: DataFrame, digits: int = 2, keys: Sequence[str] = ()) -> DataFrame:
    return metrics.select(
        *keys,
        model_label(F.col("model")).alias("model"),
        *[F.round(c, digits).alias(c) for c in ("rmse", "mae", "mape")],
        F.round(accuracy(F.col("mape")), digits).alias("accuracy"),
    )


def residuals_of(
    model: str, fitted_residuals: DataFrame, holdout: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """In-sample residuals, or holdout errors for the two models evaluated that way.

    ``ensemble`` and unknown names show the in-sample residuals.
    """
    if model in ("prophet", "lstm"):
        return residual_series(holdout.filter(F.col("model") == model), keys)
    zero = fitted_residuals.withColumns({"actual": F.col("residual"), "predicted": F.lit(0.0)})
    return residual_series(zero, keys)


residual_histogram = histogram
residual_qq = qq_points
