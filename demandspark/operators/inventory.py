"""Inventory policy from forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.functions.stats import service_level_z
from demandspark.schema import (
    DAYS_PER_YEAR,
    HOLDING_COST_PCT,
    ORDERING_COST,
    SERVICE_LEVEL,
    TOTAL,
    UNIT_COST,
)


def safety_stock(z: Column, sd: Column, lead_time_days: Column) -> Column:
    return z * sd * F.sqrt(lead_time_days)


def reorder_point(daily_demand: Column, lead_time_days: Column, safety: Column) -> Column:
    return daily_demand * lead_time_days + safety


def economic_order_quantity(
    annual_demand: Column, ordering_cost: Column, holding_cost_pct: Column, unit_cost: Column
) -> Column:
    """Square-root formula; NULL without a holding cost or with negative demand."""
    ratio = F.try_divide(2.0 * annual_demand * ordering_cost, unit_cost * holding_cost_pct)
    return F.when(ratio >= 0, F.sqrt(ratio))


def demand_summary(
    ensemble: DataFrame, keys: Sequence[str] = TOTAL, value: str = "ensemble_forecast"
) -> DataFrame:
    """Mean, sample sd and the ordered forecast itself: ``horizon`` values per row."""
    points = F.sort_array(F.collect_list(F.struct("date", F.col(value).alias("yhat"))))
    return ensemble.groupBy(*keys).agg(
        F.avg(value).alias("daily_demand"),
        F.stddev_samp(value).alias("demand_sd"),
        points.alias("points"),
    ).select(
        *keys,
        "daily_demand",
        "demand_sd",
        F.col("points.yhat").alias("daily_forecast"),
        F.col("points.date").alias("forecast_dates"),
    )


def with_policy(
    df: DataFrame,
    service_level: Column | float = SERVICE_LEVEL,
    ordering_cost: Column | float = ORDERING_COST,
    holding_cost_pct: Column | float = HOLDING_COST_PCT,
    unit_cost: Column | float = UNIT_COST,
) -> DataFrame:
    """Policy columns from daily_demand, demand_sd, lead_time_days, min_order_quantity.

    Every parameter may be a number or a column of ``df``.
    """
    def col(x: Column | float) -> Column:
        return x if isinstance(x, Column) else F.lit(float(x))

    demand, lead = F.col("daily_demand"), F.col("lead_time_days")
    return (
        df.withColumn("z_score", service_level_z(col(service_level)))
        .withColumn("safety_stock", safety_stock(F.col("z_score"), F.col("demand_sd"), lead))
        .withColumn("reorder_point", reorder_point(demand, lead, F.col("safety_stock")))
        .withColumn("annual_demand", demand * float(DAYS_PER_YEAR))
        .withColumn(
            "economic_order_quantity",
            economic_order_quantity(
                F.col("annual_demand"), col(ordering_cost), col(holding_cost_pct), col(unit_cost)
            ),
        )
        .withColumn(
            "recommended_order_quantity",
            F.greatest("economic_order_quantity", F.col("min_order_quantity").cast("double")),
        )
    )


def recommendations(
    ensemble: DataFrame,
    products: DataFrame,
    scope: str = "total",
    **policy,
) -> DataFrame:
    """One row per product with its policy and the forecast it rests on.

    ``scope="total"`` gives every product the total forecast (one summary row,
    read as a scalar subquery). ``scope="product"`` joins each product's own
    forecast; products without one keep NULL policy values.
    """
    if scope == "total":
        summary = demand_summary(ensemble)
        row = summary.select(F.struct(*summary.columns))
        joined = products.withColumn("_s", row.scalar()).select("*", "_s.*").drop("_s")
    elif scope == "product":
        joined = products.join(demand_summary(ensemble, ("product_id",)), "product_id", "left")
    else:
        raise ValueError("scope is 'total' or 'product'")
    return with_policy(joined, **policy).select(
        "product_id",
        "product_name",
        "lead_time_days",
        "safety_stock",
        "reorder_point",
        "economic_order_quantity",
        "recommended_order_quantity",
        "min_order_quantity",
        F.size("daily_forecast").alias("forecast_horizon"),
        "daily_forecast",
        "forecast_dates",
    )
