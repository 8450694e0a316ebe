"""The whole job: raw tables to forecasts, recommendations and report tables.

Every step writes Parquet and the next reads it, so a lost executor costs at
most the running step, and no plan carries the lineage of all others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.functions.calendar import Holidays
from demandspark.operators import sarimax, sequence, structural
from demandspark.operators.aggregates import daily_total
from demandspark.operators.cleaning import (
    cast_dates,
    clean_rows,
    counted_rows,
    quality_of,
    with_sales_amount,
)
from demandspark.plans.dashboard import kpi_row
from demandspark.plans.features import engineer_features
from demandspark.plans.planning import plan_inventory
from demandspark.plans.report import build_report_tables
from demandspark.schema import (
    FEATURE_HOLIDAYS,
    HORIZON,
    MODEL_HOLIDAYS,
    SPECIAL_EVENTS,
    TOTAL,
)
from demandspark.sources.stages import FACTS, read_stage, write_stage


def forecast_models(
    daily: DataFrame,
    exogenous: DataFrame | None,
    keys: Sequence[str] = TOTAL,
    horizon: int = HORIZON,
    holidays: Holidays = MODEL_HOLIDAYS,
    events: Holidays = SPECIAL_EVENTS,
    optimise: bool = True,
    cross_validation: bool = True,
    sequence_options: Mapping[str, object] | None = None,
) -> dict[str, DataFrame]:
    """What the three model families give, in tables of one row a series, model, date, fold or parameter.

    ``forecasts``, ``holdout`` and ``metrics`` of all; ``arima_orders``, ``arima_residuals``, ``arima_tests``
    and ``arima_folds``; ``structural_components``, ``structural_changepoints``, ``structural_search`` and
    ``structural_folds``; ``sequence_errors`` and, of a recurrent network, ``sequence_history``. Tables of
    what is turned off are left out. ``sequence_options`` go to the sequence model (``{"kind": "recurrent"}``).
    """
    arima = sarimax.run(daily, keys, horizon, True, cross_validation, holidays)
    parts = structural.run(daily, keys, horizon, True, cross_validation, exogenous=exogenous,
                           holidays=holidays, events=events, optimise=optimise)
    chain = sequence.run(daily, keys, horizon, **(sequence_options or {}))
    long = lambda table, columns: reduce(DataFrame.unionByName, [out[table].select(*keys, *columns) for out in (arima, parts, chain)])
    tests = arima["ljung_box"].select(*keys, "n", F.lit("ljung_box").alias("test"), "statistic", "p_value", F.col("white_noise").alias("passed"))
    tests = tests.unionByName(arima["shapiro"].select(
        *keys, "n", F.lit("shapiro_wilk").alias("test"), "statistic", "p_value", F.col("normal").alias("passed")))
    out = {
        "forecasts": long("forecast", ["model", "date", "yhat", "lower", "upper"]),
        "holdout": long("holdout", ["model", "date", "actual", "predicted"]),
        "metrics": long("metrics", [c for c in arima["metrics"].columns if c not in keys]),
        "arima_orders": arima["orders"], "arima_residuals": arima["residuals"], "arima_tests": tests,
        "structural_components": parts["forecast"], "structural_changepoints": parts["changepoints"],
        "sequence_errors": chain["errors"],
    }
    if "history" in chain:
        out["sequence_history"] = chain["history"]
    if cross_validation:
        out |= {"arima_folds": arima["cv_folds"], "structural_folds": parts["cv_by_horizon"]}
    if optimise:
        out["structural_search"] = parts["search"]
    return out


def run_weekly(
    spark: SparkSession,
    raw: Mapping[str, DataFrame],
    base: str,
    exogenous: DataFrame | None = None,
    scope: str = "total",
    horizon: int = HORIZON,
    feature_holidays: Holidays = FEATURE_HOLIDAYS,
    **model_options,
) -> dict[str, DataFrame]:
    """Runs every step under ``base`` and returns the report tables of either scope.

    Every table of :func:`forecast_models`, the plan and the KPI row are stages of their own.
    """
    keys = TOTAL if scope == "total" else ("product_id",)
    # clean rows and quality counts follow from one aggregation of each raw table
    dates = {"sales": "date", "stores": "opening_date"}
    quality = []
    for name in ("sales", "products", "stores"):
        df = cast_dates(raw[name], dates[name]) if name in dates else raw[name]
        write_stage(counted_rows(df, name == "sales"), base, f"{name}_counted")
        counted = read_stage(spark, base, f"{name}_counted")
        quality.append(quality_of(counted, name))
        clean = clean_rows(counted)
        write_stage(with_sales_amount(clean) if name == "sales" else clean, base, name, FACTS.get(name))
    write_stage(reduce(DataFrame.unionByName, quality), base, "quality")
    cleaned = {t: read_stage(spark, base, t) for t in ("sales", "products", "stores")}
    features = engineer_features(cleaned, feature_holidays)
    write_stage(features["full_features"], base, "features", "date")
    write_stage(daily_total(cleaned["sales"], keys), base, "series")
    write_stage(daily_total(cleaned["sales"]), base, "daily")
    series = read_stage(spark, base, "series")
    # without a table of regressors the structural model is fitted without them
    if exogenous is not None:
        write_stage(exogenous, base, "exogenous")
        exogenous = read_stage(spark, base, "exogenous")
    models = forecast_models(series, exogenous, keys, horizon, **model_options)
    for name, df in models.items():
        write_stage(df, base, name)
    plan = plan_inventory(
        read_stage(spark, base, "forecasts"), series, cleaned["products"], horizon, scope)
    for name, df in plan.items():
        write_stage(df, base, name)
    # how each series was fitted goes along with what follows from it
    if scope != "total":
        status = read_stage(spark, base, "arima_orders").select("product_id", F.col("status").alias("arima_status"))
        write_stage(read_stage(spark, base, "recommendations").join(status, "product_id", "left"), base, "recommendations")
    tables = {t: read_stage(spark, base, t)
              for t in ("daily", "series", "ensemble", "metrics", "recommendations")}
    write_stage(kpi_row(tables["daily"], tables["metrics"], tables["recommendations"]), base, "kpis")
    tables["kpis"] = read_stage(spark, base, "kpis")
    return build_report_tables(tables, horizon, keys) | tables
