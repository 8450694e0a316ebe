"""The whole job on a small fixture."""

from datetime import date, timedelta

import numpy as np
import pytest

from demandspark.plans.weekly import run_weekly
from demandspark.schema import MODELS, PRODUCTS_SCHEMA, SALES_SCHEMA, STORES_SCHEMA
from demandspark.sources import stages

DAY = date(2020, 1, 1)


def raw_tables(spark, days=110):
    rng = np.random.default_rng(4)
    sales = [
        (DAY + timedelta(days=i), p, s, float(max(1, round(20 + 5 * np.sin(2 * np.pi * i / 7) + rng.normal()))), 3.0)
        for i in range(days) for p in ("P1", "P2") for s in ("S1", "S2")
    ]
    return {
        "sales": spark.createDataFrame([*sales, sales[0]], SALES_SCHEMA),
        "products": spark.createDataFrame(
            [("P1", "Shirt", "A", "X", 7, 50), ("P2", "Jeans", "A", "Y", 14, 25)], PRODUCTS_SCHEMA),
        "stores": spark.createDataFrame(
            [("S1", "One", "Here", 10, DAY), ("S2", "Two", "There", 20, DAY)], STORES_SCHEMA),
    }


@pytest.mark.parametrize("scope", ["total", "product"])
def test_weekly_job(spark, tmp_path, scope):
    base = str(tmp_path / "stages")
    tables = run_weekly(spark, raw_tables(spark), base, scope=scope)
    quality = {r.table_name: r for r in stages.read_stage(spark, base, "quality").collect()}
    assert quality["sales"].duplicate_rows == 1 and quality["sales"].rows_out == 440
    ensemble = stages.read_stage(spark, base, "ensemble").collect()
    assert len(ensemble) == (7 if scope == "total" else 14)
    for row in ensemble:
        parts = [row[f"{m}_forecast"] for m in MODELS]
        assert all(p is not None for p in parts)
        assert abs(row.ensemble_forecast - sum(parts) / 3) < 1e-9
    recs = stages.read_stage(spark, base, "recommendations").collect()
    assert {r.product_id for r in recs} == {"P1", "P2"}
    assert all(r.recommended_order_quantity >= r.min_order_quantity for r in recs)
    metrics = stages.read_stage(spark, base, "metrics").collect()
    assert {r.model for r in metrics} == set(MODELS) and all(r.n == 8 for r in metrics)
    # the series is a clear weekly wave: every family must find it
    assert all(r.mape < 15 for r in metrics)
    n = 1 if scope == "total" else 2
    assert tables["forecast_chart"].count() == n * (110 + 4 * 7)
    assert tables["product_policy"].count() == 8 and tables["key_metrics"].count() == 2 * n
    assert tables["forecast_table"].count() == 7 * n and tables["model_performance"].count() == 3 * n
    # every step is a stage of its own
    read = lambda name: stages.read_stage(spark, base, name)
    kpis = read("kpis").first()
    assert kpis.total_sales == read("daily").agg({"total_sales": "sum"}).first()[0] and 0 <= kpis.forecast_accuracy <= 100
    assert read("arima_orders").filter("status = 'fitted'").count() == n
    assert read("arima_residuals").filter("residual IS NOT NULL").count() == 110 * n
    assert {r.test for r in read("arima_tests").collect()} == {"ljung_box", "shapiro_wilk"}
    assert read("arima_folds").count() == 5 * n or read("arima_folds").count() == 4 * n
    assert read("structural_search").count() == 160 * n and read("structural_folds").count() == 7 * n
    assert read("structural_components").count() == 7 * n and read("structural_changepoints").count() == 25 * n
    assert read("sequence_errors").count() >= 2 and read("holdout").count() == 3 * 8 * n
    if scope == "product":
        assert all(r.arima_status == "fitted" for r in recs)


def test_weekly_job_without_search_and_folds(spark, tmp_path):
    base = str(tmp_path / "stages")
    run_weekly(spark, raw_tables(spark, 60), base, optimise=False, cross_validation=False)
    assert stages.stages_available(spark, base, ["kpis", "structural_components", "arima_orders"])
    assert not any(stages.stage_exists(spark, base, t) for t in ("structural_search", "structural_folds", "arima_folds"))


def test_weekly_job_with_a_recurrent_network(spark, tmp_path):
    base = str(tmp_path / "stages")
    run_weekly(spark, raw_tables(spark, 60), base, optimise=False, cross_validation=False,
               sequence_options={"kind": "recurrent", "units": 4, "epochs": 4})
    read = lambda name: stages.read_stage(spark, base, name)
    history = read("sequence_history").collect()
    assert sorted((r.epoch, r.split) for r in history) == [(e, s) for e in range(5) for s in ("train", "validation")]
    assert all(r.lstm_forecast is not None for r in read("ensemble").collect())
    assert read("holdout").filter("model = 'lstm'").count() == 8
