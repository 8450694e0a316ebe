"""Sources, cleaning, calendar, panel and policy operators on small fixtures."""

from datetime import date, timedelta
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Row
from pyspark.sql import functions as F

from demandspark.functions import formatting, metrics, stats
from demandspark.functions.calendar import report_range, with_date_flag, with_date_parts
from demandspark.operators import aggregates, cleaning, diagnostics, ensemble, grids, inventory, panel
from demandspark.operators.gram import attach
from demandspark.plans import dashboard
from demandspark.plans.features import engineer_features
from demandspark.schema import (
    ARIMA_DEFAULT_GRID,
    FEATURE_HOLIDAYS,
    PRODUCTS_SCHEMA,
    SALES_SCHEMA,
    SERIES_KEYS,
)
from demandspark.sources import csv, jdbc, stages

DAY = date(2020, 1, 1)


def sales_rows(spark, days=31):
    """Two products in two stores, one row a day, hand-checkable quantities."""
    rows = [
        (DAY + timedelta(days=i), p, s, float(10 * pi + si + i), 2.5)
        for i in range(days) for pi, p in enumerate(("P1", "P2"), 1) for si, s in enumerate(("S1", "S2"))
    ]
    return spark.createDataFrame(rows, SALES_SCHEMA)


def test_csv_trims_and_reads_missing(spark, tmp_path):
    path = tmp_path / "product_info.csv"
    path.write_text(
        "product_id,product_name,category,supplier,lead_time_days,min_order_quantity\n"
        "P1, Shirt ,Apparel,NA,7,50\nP2,Jeans,,B,14,25 "
    )
    rows = csv.load_csv(spark, str(path), PRODUCTS_SCHEMA).orderBy("product_id").collect()
    assert rows[0].product_name == "Shirt" and rows[0].supplier is None
    assert rows[1].category is None and rows[1].min_order_quantity == 25
    with pytest.raises(PySparkException):
        csv.load_csv(spark, str(tmp_path / "missing.csv"), PRODUCTS_SCHEMA)


def test_csv_inferred_schema(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1, x \nNA,y\n")
    df = csv.load_csv(spark, str(path))
    assert dict(df.dtypes) == {"a": "int", "b": "string"}
    assert df.filter("a IS NULL").count() == 1


def test_jdbc_options():
    options = jdbc.jdbc_options("jdbc:x", query="select 1")
    assert options["query"] == "select 1" and "dbtable" not in options
    split = jdbc.jdbc_options("jdbc:x", table="t", partition_column="id", lower_bound=0,
                              upper_bound=9, num_partitions=3)
    assert split["partitionColumn"] == "id" and split["numPartitions"] == "3"
    with pytest.raises(ValueError):
        jdbc.jdbc_options("jdbc:x")
    with pytest.raises(ValueError):
        jdbc.jdbc_options("jdbc:x", query="q", num_partitions=3)


def test_stages(spark, tmp_path):
    base = str(tmp_path / "stage")
    assert not stages.stages_available(spark, base, ["sales"])
    with pytest.raises(FileNotFoundError):
        stages.load_all(spark, base, ["sales"])
    sales = sales_rows(spark, 40)
    stages.write_stage(sales, base, "sales", "date")
    stages.write_stage(sales, base, "sales", "date")  # a rerun replaces, it does not append
    back = stages.read_stage(spark, base, "sales")
    assert back.columns == sales.columns and back.exceptAll(sales).count() == 0
    assert back.count() == sales.count()


def test_cleaning_counts_and_nan(spark):
    rows = [
        ("2020-01-01", "P1", "S1", 1.0, 2.0),
        ("2020-01-01", "P1", "S1", 1.0, 2.0),
        ("2020-13-01", "P1", "S1", 1.0, 2.0),
        ("2020-01-02", "P1", "S1", float("nan"), 2.0),
        ("2020-01-03", None, "S1", None, 2.0),
    ]
    raw = spark.createDataFrame(
        rows, "date string, product_id string, store_id string, sales_quantity double, unit_price double")
    cast = cleaning.cast_dates(raw, "date")
    counts = cleaning.missing_counts(cast).first()
    assert counts.date_missing == 1 and counts.sales_quantity_missing == 2 and counts.missing_total == 4
    clean = cleaning.clean_sales(raw).collect()
    assert len(clean) == 1 and clean[0].sales_amount == 2.0
    assert cleaning.duplicate_count(cleaning.complete_cases(cast)).first().duplicates == 1
    report = cleaning.quality_row(cast, "sales", True).first()
    assert (report.rows_in, report.missing_cells, report.incomplete_rows) == (5, 4, 3)
    assert (report.duplicate_rows, report.rows_out) == (1, 1)


def test_calendar(spark):
    df = with_date_parts(spark.createDataFrame([(DAY,), (date(2021, 1, 1),)], "date date"))
    first, second = df.orderBy("date").collect()
    assert (first.day_of_week, first.week_of_year, first.quarter, first.is_weekend) == ("Wed", 1, 1, 0)
    assert second.week_of_year == 53
    days = spark.range(31).select(F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("date"))
    flagged = with_date_flag(days, FEATURE_HOLIDAYS, "h").filter("h = 1").orderBy("date").collect()
    assert [r.date.day for r in flagged] == [1, 20]
    table = spark.createDataFrame([(date(2020, 1, 20),)], "date date")
    assert with_date_flag(days, table, "h", shift=1).filter("h = 1").first().date.day == 21
    start, _ = report_range(F.lit("monthly"), F.lit("2020-03-31").cast("date"))
    assert spark.range(1).select(start.alias("s")).first().s == date(2020, 2, 29)


def test_features_on_sample(spark):
    tables = {"sales": cleaning.clean_sales(sales_rows(spark)), "products": None, "stores": None}
    full = engineer_features(tables)["full_features"]
    assert full.filter("sales_lag1 IS NULL").count() == 4
    assert full.filter("sales_lag7 IS NULL").count() == 28
    head = full.filter("product_id = 'P1' AND store_id = 'S1'").orderBy("date").limit(3).collect()
    assert [r.sales_ma7 for r in head] == [10.0, 10.5, 11.0]
    assert head[1].sales_lag1 == 10.0 and head[0].is_holiday == 1.0
    daily = aggregates.daily_total(tables["sales"]).orderBy("date").first()
    assert daily.total_sales == 10 + 11 + 20 + 21


def test_copies_of_a_key_are_an_error(spark):
    sales = sales_rows(spark, 3)
    twice = sales.unionByName(sales.withColumn("sales_quantity", F.lit(1.0)))
    assert panel.panel_violations(twice).count() == 12
    with pytest.raises(PySparkException):
        panel.with_lags(twice, "sales_quantity", (1,)).collect()


def test_folds_and_cutoffs(spark):
    daily = aggregates.daily_total(sales_rows(spark))
    folds = panel.expanding_folds(daily, 5, ()).filter("split = 'test'")
    spans = folds.groupBy("fold").agg(F.min("date").alias("a"), F.max("date").alias("b")).orderBy("fold")
    assert [(r.a.day, r.b.day) for r in spans.collect()] == [(2, 7), (8, 13), (14, 19), (20, 25), (26, 31)]
    # 30 rows: fold 1 would train on nothing
    assert panel.expanding_folds(daily.filter("date < '2020-01-31'"), 5, ()).select(
        F.min("fold")).first()[0] == 2
    assert panel.rolling_cutoffs(daily, 20, 5, 7, ()).collect() == [Row(cutoff=date(2020, 1, 24))]
    assert panel.rolling_test_rows(daily, 20, 5, 7, ()).count() == 7
    split = panel.holdout_split(daily, keys=()).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 23, "test": 8}
    assert panel.sequence_windows(daily, "total_sales", 7, ()).count() == 24


def test_rolling_rows_match_brute_force(spark):
    days = [0, 1, 2, 5, 9, 10, 11, 12, 17, 25, 30, 31, 40, 41, 43]
    df = spark.createDataFrame([(DAY + timedelta(days=d),) for d in days], "date date")
    for initial, period, horizon in ((10, 3, 7), (5, 10, 4), (0, 1, 1), (100, 5, 7)):
        cutoffs = [c for c in range(43 - horizon, initial - 1, -period)]
        want = {(d, c) for c in cutoffs for d in days if c < d <= c + horizon}
        got = panel.rolling_test_rows(df, initial, period, horizon, ()).collect()
        assert {((r.date - DAY).days, (r.cutoff - DAY).days) for r in got} == want


def test_gaps_and_short_series(spark):
    df = spark.createDataFrame([("a", DAY, 1.0), ("a", DAY + timedelta(days=3), 4.0), ("b", DAY, 2.0)],
                               "k string, date date, v double")
    filled = panel.fill_gaps(df, "v", ("k",)).orderBy("k", "date").collect()
    assert [r.v for r in filled] == [1.0, 0.0, 0.0, 4.0, 2.0]
    scale = {r.k: r.sd for r in panel.normalisation(df, "v", ("k",)).collect()}
    assert scale["b"] is None and scale["a"] > 0


def test_metrics_edges(spark):
    df = spark.createDataFrame([("zero", 0.0, 1.0), ("zero", 2.0, 1.0), ("flat", 3.0, 3.5), ("flat", 3.0, 2.5)],
                               "k string, actual double, predicted double")
    rows = {r.k: r for r in metrics.evaluate(df, ["k"]).collect()}
    assert rows["zero"].mape == 50.0 and rows["zero"].n_undefined == 1 and rows["zero"].rmse == 1.0
    assert rows["flat"].r_squared is None and rows["flat"].mae == 0.5


def test_service_levels(spark):
    levels = spark.createDataFrame([(0.95,), (0.99,), (0.9,), (0.5,), (1.0,)], "p double")
    z = [r.z for r in levels.select(stats.service_level_z(F.col("p")).alias("z")).collect()]
    assert z[:2] == [1.645, 2.326] and abs(z[2] - 1.2815515655) < 1e-8 and abs(z[3]) < 1e-12 and z[4] is None
    tail = spark.range(1).select(stats.chi2_upper_tail_even(F.lit(18.307), 10).alias("p")).first().p
    assert abs(tail - 0.05) < 1e-4


def forecasts(spark, keys=("product_id",)):
    rows = [("P1", m, DAY + timedelta(days=i), float(v + i))
            for m, v in (("arima", 10), ("prophet", 20), ("lstm", 30)) for i in range(7)]
    return spark.createDataFrame(rows, "product_id string, model string, date date, yhat double")


def test_ensemble_and_policy(spark):
    long = forecasts(spark)
    frame = ensemble.ensemble_frame(long, ("product_id",))
    assert [r.ensemble_forecast for r in frame.orderBy("date").collect()] == [20.0 + i for i in range(7)]
    weighted = ensemble.weighted_ensemble(long, {"arima": 1.0, "prophet": 1.0, "lstm": 2.0}, ("product_id",))
    assert weighted.orderBy("date").first().ensemble_forecast == 22.5
    products = spark.createDataFrame(
        [("P1", "Shirt", "A", "S", 4, 50), ("P9", "Other", "A", "S", 4, 50)], PRODUCTS_SCHEMA)
    recs = {r.product_id: r for r in inventory.recommendations(frame, products, "product").collect()}
    sd = (28 / 6) ** 0.5
    assert abs(recs["P1"].safety_stock - 1.645 * sd * 2) < 1e-9
    assert abs(recs["P1"].reorder_point - (23 * 4 + 1.645 * sd * 2)) < 1e-9
    assert abs(recs["P1"].economic_order_quantity - (2 * 23 * 365 * 50 / 2.5) ** 0.5) < 1e-9
    assert recs["P1"].daily_forecast == [20.0 + i for i in range(7)]
    assert recs["P9"].safety_stock is None
    total = inventory.recommendations(frame.drop("product_id"), products)
    assert total.count() == 2 and total.filter("safety_stock IS NULL").count() == 0
    status = dashboard.inventory_status(total, dashboard.demo_stock(total)).collect()
    assert {r.status for r in status} <= {"Critical", "Reorder", "OK"}
    assert dashboard.planning_lines(total, "P9").first().product_id == "P9"
    assert dashboard.planning_lines(total, "nope").first().product_id == "P1"


def test_grids_and_ties(spark):
    one = spark.range(1).select(F.lit("a").alias("k"))
    assert grids.with_order_grid(one).count() == 96
    assert grids.with_order_grid(one, ARIMA_DEFAULT_GRID).count() == 720
    assert grids.with_value_grid(one).count() == 160
    scores = spark.createDataFrame([("a", 2, 1.0), ("a", 1, 1.0), ("a", 0, float("nan")), ("b", 0, None)],
                                   "k string, grid_id int, s double")
    best = {r.k: r.grid_id for r in grids.best_candidate(scores, "s", ("k",)).collect()}
    assert best == {"a": 1, "b": 0}


def test_shapiro_published_value(spark):
    # a published sample of 32 fuel economies: W = 0.94756, p = 0.1229
    mpg = [21, 21, 22.8, 21.4, 18.7, 18.1, 14.3, 24.4, 22.8, 19.2, 17.8, 16.4, 17.3, 15.2, 10.4, 10.4,
           14.7, 32.4, 30.4, 33.9, 21.5, 15.5, 15.2, 13.3, 19.2, 27.3, 26, 30.4, 15.8, 19.7, 15, 21.4]
    df = spark.createDataFrame([(float(x),) for x in mpg], "residual double")
    row = diagnostics.shapiro_wilk(df).first()
    assert abs(row.statistic - 0.94756) < 2e-5 and abs(row.p_value - 0.1229) < 2e-4 and row.normal
    # five values by the weights tabled in 1965 (0.6646 and 0.2413): W = 0.9162, between the 10% and 50% points
    tiny = diagnostics.shapiro_wilk(df.limit(5)).first()
    assert abs(tiny.statistic - 0.9162) < 5e-4 and 0.1 < tiny.p_value < 0.55 and tiny.normal and not tiny.extrapolated
    # three values: W = 0.96429, p = 0.6369
    three = diagnostics.shapiro_wilk(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "residual double")).first()
    assert abs(three.statistic - 0.96429) < 1e-5 and abs(three.p_value - 0.6369) < 1e-4
    two = diagnostics.shapiro_wilk(spark.createDataFrame([(1.0,), (2.0,)], "residual double")).first()
    assert two.statistic is None and two.p_value is None
    many = diagnostics.shapiro_wilk(spark.range(6000).selectExpr("double(id % 997) AS residual")).first()
    assert many.extrapolated and many.n == 6000 and not many.normal


def royston(values):
    """W and p of three or more values, written out with exact normal quantiles."""
    x, n, normal = np.sort(values), len(values), NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    a, u, size = m.copy(), n**-0.5, np.log(n)
    if n == 3:
        a = np.array([-(0.5**0.5), 0.0, 0.5**0.5])
    else:
        ends = [np.polyval(diagnostics.LAST_WEIGHT, u) + m[-1] / np.sqrt(m @ m)]
        if n > 5:
            ends.append(np.polyval(diagnostics.SECOND_WEIGHT, u) + m[-2] / np.sqrt(m @ m))
        k = len(ends)
        a[k : n - k] /= np.sqrt((m @ m - 2 * sum(m[-k:] ** 2)) / (1 - 2 * sum(np.square(ends))))
        a[:k], a[n - k :] = -np.array(ends), ends[::-1]
    w = (a @ x) ** 2 / sum((x - x.mean()) ** 2)
    if n == 3:
        return w, 6 / np.pi * (np.arcsin(w**0.5) - np.arcsin(0.75**0.5))
    y = np.log(1 - w)
    if n < 12:
        y = -np.log(0.459 * n - 2.273 - y)
        mean = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sd = np.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        mean, sd = np.polyval(diagnostics.LOG_MEAN, size), np.exp(np.polyval(diagnostics.LOG_SD, size))
    return w, 1 - normal.cdf((y - mean) / sd)


def test_shapiro_of_short_and_long_groups(spark):
    rng = np.random.default_rng(4)
    # published: W = 0.79, p = 0.0067 for eleven weights
    groups = {11: np.array([148.0, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]), 3: np.array([1.0, 2, 4])}
    groups |= {n: rng.normal(size=n) for n in (4, 5, 6, 8, 10, 12, 5000, 6000)} | {1: np.ones(1), 2: np.arange(2.0), 7: np.ones(7)}
    df = spark.createDataFrame([(n, float(x)) for n, xs in groups.items() for x in xs], "k long, residual double")
    got = {r.k: r for r in diagnostics.shapiro_wilk(df, keys=("k",)).collect()}
    assert sorted(got) == sorted(groups) and [k for k, r in got.items() if r.extrapolated] == [6000]
    assert abs(got[11].statistic - 0.78881) < 1e-4 and abs(got[11].p_value - 0.0067) < 1e-4 and not got[11].normal
    assert abs(got[3].statistic - 0.96429) < 1e-4 and abs(got[3].p_value - 0.6369) < 1e-4
    for n, xs in groups.items():
        if n in (1, 2, 7):
            assert got[n].statistic is None and got[n].p_value is None
        else:
            assert np.allclose((got[n].statistic, got[n].p_value), royston(xs), atol=1e-5), n


def test_decomposition_adds_up(spark):
    rows = [(DAY + timedelta(days=i), float(100 + i + (5 if i % 7 == 0 else 0))) for i in range(70)]
    df = diagnostics.decompose(spark.createDataFrame(rows, "date date, total_sales double"))
    parts = df.collect()
    assert all(abs(r.observed - r.trend - r.seasonal - r.remainder) < 1e-9 for r in parts)
    assert max(r.seasonal for r in parts) > 3


def test_attach_without_keys_is_no_join(spark):
    df = spark.range(3)
    plan = attach(df, df.agg(F.max("id").alias("m")), ())
    assert plan.filter("m = 2").count() == 3
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_formatting(spark):
    row = spark.range(1).select(
        formatting.format_number(F.lit(1234567.891), 2).alias("n"),
        formatting.format_currency(F.lit(0.5)).alias("c"),
        formatting.format_date(F.lit("2020-01-05").cast("date")).alias("d"),
        formatting.percent_change(F.lit(11.0), F.lit(10.0)).alias("up"),
        formatting.percent_change(F.lit(9.0), F.lit(10.0)).alias("down"),
        formatting.percent_change(F.lit(9.0), F.lit(0.0)).alias("none"),
    ).first()
    assert tuple(row) == ("1,234,567.89", "$0.50", "January 05, 2020", "+10.0%", "-10.0%", None)


def test_keys_are_the_default():
    assert SERIES_KEYS == ("product_id", "store_id")


def test_windows_refuse_two_rows_of_a_date(spark):
    rows = [("a", DAY + timedelta(days=i), float(i)) for i in range(12)] + [("a", DAY + timedelta(days=5), 1.0)]
    df = spark.createDataFrame(rows, "k string, date date, v double")
    for made in (panel.with_trailing_means(df, "v", [7], ["k"]), panel.with_cumulative_sum(df, "v", "s", ["k"]), panel.sequence_windows(df, "v", 3, ["k"])):
        with pytest.raises(Exception, match="do not identify a row"):
            made.collect()
