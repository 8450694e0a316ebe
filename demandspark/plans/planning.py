"""Inventory planning: forecasts in, ensemble and recommendations out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from demandspark.operators.ensemble import ensemble_frame, first_future_values
from demandspark.operators.inventory import recommendations
from demandspark.schema import HORIZON, TOTAL


def plan_inventory(
    forecasts: DataFrame,
    history: DataFrame,
    products: DataFrame,
    horizon: int = HORIZON,
    scope: str = "total",
    **policy,
) -> dict[str, DataFrame]:
    """``ensemble`` and ``recommendations`` for the next ``horizon`` days."""
    keys = TOTAL if scope == "total" else ("product_id",)
    future = first_future_values(forecasts, history, horizon, keys)
    ensemble = ensemble_frame(future, keys)
    return {
        "ensemble": ensemble,
        "recommendations": recommendations(ensemble, products, scope, **policy),
    }
