"""Properties of the forecasting models on fixtures with a known answer."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandspark.operators import gram, sarimax, sequence, structural
from demandspark.operators.regressors import demo_exogenous
from demandspark.schema import STRUCTURAL_DEFAULTS, STRUCTURAL_GRID
from demandspark.streaming import refresh

DAY = date(2020, 1, 1)
K = ("k",)


def frame(spark, series: dict):
    rows = [(k, DAY + timedelta(days=i), float(v)) for k, ys in series.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "k string, date date, total_sales double")


def arma(n, phi=0.0, theta=0.0, seed=0, level=50.0):
    rng = np.random.default_rng(seed)
    e, y = rng.normal(size=n + 200), np.zeros(n + 200)
    for t in range(1, n + 200):
        y[t] = phi * y[t - 1] + e[t] + theta * e[t - 1]
    return level + y[200:]


def weekly(n, seed=1, slope=0.5, noise=0.5):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 100 + slope * t + 10 * np.sin(2 * np.pi * t / 7) + noise * rng.normal(size=n)


def test_gram_equals_numpy_whatever_the_partitioning(spark):
    rng = np.random.default_rng(3)
    x, k = rng.normal(size=(600, 4)), rng.integers(0, 3, 600)
    y = x @ [1.0, -2.0, 0.5, 3.0] + rng.normal(size=600)
    pdf = pd.DataFrame({"k": [f"s{i}" for i in k], "x": list(x), "y": y})
    df = spark.createDataFrame(pdf, "k string, x array<double>, y double")
    fields = [T.StructField("coef", sarimax.DOUBLES), T.StructField("n", T.LongType())]
    for parts in (1, 7):
        got = gram.solve_per_series(
            gram.gram_partials(df.repartition(parts), K), K,
            lambda _k, n, g, b, _y: [(gram.least_squares(g, b), n)], fields).collect()
        for row in got:
            own = np.array([f"s{i}" == row.k for i in k])
            want = np.linalg.lstsq(x[own], y[own], rcond=None)[0]
            assert row.n == own.sum() and np.allclose(row.coef, want, atol=1e-10)


def test_rank_deficient_solve():
    x = np.column_stack([np.ones(20), np.arange(20.0), np.zeros(20), np.ones(20)])
    y = 3 + 2 * np.arange(20.0)
    coef = gram.least_squares(x.T @ x, x.T @ y)
    assert np.allclose(x @ coef, y)


def test_differencing_weights():
    assert sarimax.difference_weights(0, 0, 7) == {0: 1.0}
    assert sarimax.difference_weights(1, 1, 7) == {0: 1.0, 1: -1.0, 7: -1.0, 8: 1.0}
    assert sarimax.difference_weights(2, 0, 7) == {0: 1.0, 1: -2.0, 2: 1.0}


def test_candidate_counts():
    from demandspark.schema import ARIMA_DEFAULT_GRID, ARIMA_RUN_GRID

    assert len(sarimax.candidates(ARIMA_RUN_GRID, 7)) == 96
    assert len(sarimax.candidates(ARIMA_DEFAULT_GRID, 7)) == 720
    assert len(sarimax.candidates(ARIMA_DEFAULT_GRID, None)) == 48


def test_arma_is_recovered(spark):
    df = frame(spark, {"ar": arma(3000, 0.6), "arma": arma(3000, 0.6, 0.4, 5)})
    orders = spark.createDataFrame(
        [("ar", 1, 0, 0, 0, 0, 0), ("arma", 1, 0, 1, 0, 0, 0)], ["k", *sarimax.ORDERS]
    ).select("k", *[F.col(c).cast("int") for c in sarimax.ORDERS])
    coef, fitted = sarimax.fit(sarimax.with_design(df, regressors=False), orders, K)
    rows = {r.k: r for r in coef.collect()}
    mean = rows["ar"].beta[0] / (1 - rows["ar"].ar[0])
    assert abs(rows["ar"].ar[0] - 0.6) < 0.05 and abs(mean - 50) < 0.5
    assert abs(rows["arma"].ar[0] - 0.6) < 0.06 and abs(rows["arma"].ma[0] - 0.4) < 0.06
    spread = fitted.groupBy("k").agg(F.avg("residual").alias("m"), F.stddev("residual").alias("s"))
    for r in spread.collect():
        assert abs(r.m) < 0.05 and abs(r.s - 1.0) < 0.05


def test_a_residual_for_every_row(spark):
    long = arma(200, 0.6)
    df = frame(spark, {"ar": long, "walk": 100 + np.cumsum(long - 50), "week": weekly(120), "short": long[:9]})
    orders = spark.createDataFrame(
        [("ar", 1, 0, 0, 0, 0, 0), ("walk", 0, 1, 0, 0, 0, 0), ("week", 1, 0, 0, 0, 1, 1), ("short", 1, 0, 0, 0, 0, 0)], ["k", *sarimax.ORDERS]
    ).select("k", *[F.col(c).cast("int") for c in sarimax.ORDERS])
    coef, fitted = sarimax.fit(sarimax.with_design(df, regressors=False), orders, K)
    got = {k: p.sort_values("date") for k, p in fitted.toPandas().groupby("k")}
    assert {k: len(p) for k, p in got.items()} == {"ar": 200, "walk": 200, "week": 120, "short": 9}
    assert got["short"].residual.isna().all()
    c = {r.k: r for r in coef.collect()}
    assert sorted(c) == ["ar", "walk", "week"] and [c[k].n_eff for k in ("ar", "walk", "week")] == [179, 178, 92]
    before = np.concatenate([[long.mean()], long[:-1]])
    assert np.allclose(got["ar"].residual, long - c["ar"].beta[0] - c["ar"].ar[0] * before)
    assert np.allclose(got["walk"].residual, np.diff(got["walk"].value, prepend=got["walk"].value.iloc[0]))
    assert np.isfinite(got["week"].residual).all()


def test_search_and_forecast(spark):
    df = frame(spark, {"a": weekly(150), "b": arma(150, 0.5, seed=9)})
    scored = sarimax.search_orders(df, K)
    assert scored.groupBy("k").count().filter("count = 96").count() == 2
    best = {r.k: r for r in sarimax.best_orders(scored, K).collect()}
    low = {r.k: r.m for r in scored.groupBy("k").agg(F.min("aic").alias("m")).collect()}
    assert all(best[k].aic == low[k] for k in low)
    out = sarimax.train(df, K)
    ahead = out["forecast"].orderBy("k", "date").collect()
    assert len(ahead) == 14 and all(r.lower < r.yhat < r.upper for r in ahead)
    truth = 100 + 0.5 * np.arange(150, 157) + 10 * np.sin(2 * np.pi * np.arange(150, 157) / 7)
    assert np.abs([r.yhat - t for r, t in zip(ahead[:7], truth)]).max() < 4.0
    widths = [r.upper - r.lower for r in ahead[:7]]
    assert all(b >= a - 1e-9 for a, b in zip(widths, widths[1:]))
    assert out["ljung_box"].count() == 2 and out["shapiro"].count() == 2


def test_random_walk_interval_grows_with_the_root_of_time(spark):
    rng = np.random.default_rng(2)
    df = frame(spark, {"w": 100 + np.cumsum(rng.normal(size=400))})
    orders = spark.createDataFrame([("w", 0, 1, 0, 0, 0, 0)], ["k", *sarimax.ORDERS]).select(
        "k", *[F.col(c).cast("int") for c in sarimax.ORDERS])
    coef, fitted = sarimax.fit(sarimax.with_design(df, regressors=False), orders, K)
    future = sarimax.with_design(sarimax.future_dates(df, 9, K), regressors=False)
    known = sarimax.with_design(df, regressors=False)
    rows = sarimax.forecast(coef, fitted, known, future, K).orderBy("date").collect()
    half = np.array([r.upper - r.yhat for r in rows])
    assert np.allclose(half / half[0], np.sqrt(np.arange(1, 10)), rtol=1e-6)
    last = df.orderBy(F.desc("date")).first().total_sales
    assert all(abs(r.yhat - last) < 1e-6 for r in rows)


def test_holdout_uses_training_rows_only(spark):
    y = weekly(160)
    spoiled = y.copy()
    spoiled[-8:] += 1000
    one = sarimax.evaluate_holdout(frame(spark, {"a": y}), K)[0].orderBy("date").collect()
    two = sarimax.evaluate_holdout(frame(spark, {"a": spoiled}), K)[0].orderBy("date").collect()
    assert len(one) == 8 and np.allclose([r.predicted for r in one], [r.predicted for r in two])


def test_a_fold_with_too_few_training_rows_keeps_its_row(spark):
    per_fold, mean = sarimax.cross_validate(frame(spark, {"a": weekly(78)}), K, k=5)
    rows = {r["fold"]: r for r in per_fold.collect()}
    # folds of 15 rows; the first trains on 3
    assert sorted(rows) == [1, 2, 3, 4, 5] and {r["n_test"] for r in rows.values()} == {15}
    assert not rows[1]["fitted"] and rows[1]["n"] == 0 and rows[1]["rmse"] is None
    assert rows[5]["fitted"] and rows[5]["n"] == 15
    assert mean.first()["folds"] == sum(r["fitted"] for r in rows.values())


def test_cross_validation_folds(spark):
    per_fold, mean = sarimax.cross_validate(frame(spark, {"a": weekly(251)}), K, k=3)
    rows = per_fold.orderBy("fold").collect()
    # the first fold trains on two rows: it has a row but no fit
    assert [r.fold for r in rows] == [1, 2, 3] and [r.n for r in rows] == [0, 83, 83]
    assert all(r.n_test == 83 for r in rows)
    assert abs(mean.first().avg_mae - np.mean([r.mae for r in rows[1:]])) < 1e-9


def structural_rows(spark, n=200, noise=0.0):
    df = frame(spark, {"a": weekly(n, noise=noise)})
    return df, structural.with_effects(df)


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_structural_recovers_trend_and_week(spark, mode):
    df, rows = structural_rows(spark)
    loose = {**STRUCTURAL_DEFAULTS, "seasonality_mode": mode}
    coef = structural.fit(rows, loose, K)
    ahead = structural.with_effects(structural.future_dates(df, 7, K).drop("step"))
    got = structural.predict(coef, ahead, K).orderBy("date").collect()
    t = np.arange(200, 207)
    truth = 100 + 0.5 * t + 10 * np.sin(2 * np.pi * t / 7)
    limit = 0.5 if mode == "additive" else 6.0
    assert np.abs([r.yhat - v for r, v in zip(got, truth)]).max() < limit
    for r in got:
        rest = r.weekly + r.monthly + r.holidays + r.regressors
        want = r.trend + rest if mode == "additive" else r.trend * (1 + rest)
        assert abs(r.yhat - want) < 1e-9 and r.lower <= r.yhat <= r.upper


def test_structural_with_regressors_and_changepoints(spark):
    df = frame(spark, {"a": weekly(120), "b": weekly(90, 4)})
    exogenous = demo_exogenous(df.select("date"))
    out = structural.train(df, K, exogenous=exogenous, optimise=False)
    assert out["forecast"].groupBy("k").count().filter("count = 7").count() == 2
    points = out["changepoints"].groupBy("k").agg(F.count("*").alias("n"), F.max("date").alias("d"))
    for r in points.collect():
        last = 119 if r.k == "a" else 89
        assert r.n == 25 and abs((r.d - DAY).days - 0.8 * last) <= 1


def test_parameters_may_differ_per_series(spark):
    df = frame(spark, {"a": weekly(120), "b": weekly(120, 4)})
    rows = structural.with_effects(df)
    choice = spark.createDataFrame(
        [("a", 0.05, 10.0, 10.0, "additive"), ("b", 0.05, 10.0, 10.0, "multiplicative")],
        ["k", *structural.PARAMETERS])
    mixed = {r.k: r for r in structural.fit(rows, choice, K).collect()}
    for k, mode in (("a", "additive"), ("b", "multiplicative")):
        alone = structural.fit(
            rows.filter(F.col("k") == k), {**STRUCTURAL_DEFAULTS, "seasonality_mode": mode}, K).first()
        assert np.allclose(mixed[k].trend, alone.trend) and np.allclose(mixed[k].effect, alone.effect)


def test_rolling_forecasts_agree_with_a_plain_fit(spark):
    df, rows = structural_rows(spark, 130, noise=1.0)
    for mode in ("additive", "multiplicative"):
        chosen = {**STRUCTURAL_DEFAULTS, "seasonality_mode": mode}
        rolled = structural.rolling_forecasts(rows, chosen, K, initial=60, period=20, horizon=7, parts=3)
        cutoffs = sorted({r.cutoff for r in rolled.select("cutoff").distinct().collect()})
        assert [(c - DAY).days for c in cutoffs] == [62, 82, 102, 122]
        cutoff = cutoffs[2]
        known = rows.filter(F.col("date") <= F.lit(cutoff))
        plain = structural.predict(structural.fit(known, chosen, K), rows, K)
        both = rolled.filter(F.col("cutoff") == F.lit(cutoff)).join(plain, ["k", "date"]).collect()
        assert len(both) == 7 and all(abs(r.predicted - r.yhat) < 0.05 for r in both)


def test_parameter_search_matches_its_own_rolling_forecasts(spark):
    _df, rows = structural_rows(spark, 100, noise=2.0)
    values = {**STRUCTURAL_GRID, "changepoint_prior_scale": [0.05, 0.5], "holidays_prior_scale": [10.0]}
    found = structural.search_parameters(rows, K, values, parts=2)
    assert found.count() == 16
    best = structural.best_parameters(found, K).first()
    assert best.rmse == found.agg(F.min("rmse")).first()[0]
    chosen = {p: best[p] for p in structural.PARAMETERS}
    rolled = structural.rolling_forecasts(rows, chosen, K, 30, 7, 7)
    again = structural.by_horizon(rolled, K).agg(F.avg("rmse")).first()[0]
    assert abs(again - best.rmse) < 1e-6


def test_linear_sequence_forecast_equals_a_plain_loop(spark):
    df = frame(spark, {"a": weekly(90), "b": arma(80, 0.7), "flat": [5.0] * 40, "short": [1.0, 2.0]})
    model = sequence.train(df, K)
    got = sequence.forecast(model, df, 5)
    assert {r.k for r in got.select("k").distinct().collect()} == {"a", "b", "flat", "short"}
    assert {r.yhat for r in got.filter("k = 'flat'").collect()} == {5.0}
    for k, ys in (("a", weekly(90)), ("b", arma(80, 0.7))):
        mean, sd = np.mean(ys), np.std(ys, ddof=1)
        state = list((np.array(ys[-7:]) - mean) / sd)
        want = []
        for _ in range(5):
            nxt = float(np.dot(state[-7:], model.regressor.coefficients.toArray()) + model.regressor.intercept)
            state.append(nxt)
            want.append(nxt * sd + mean)
        rows = got.filter(F.col("k") == k).orderBy("date").collect()
        assert np.allclose([r.yhat for r in rows], want)
        assert np.allclose([r.lower for r in rows], np.array(want) * 0.9)
    errors = {r.split: r for r in model.errors.collect()}
    assert errors["train"].n == int(0.8 * 83) + int(0.8 * 73)


def test_tree_sequence_forecast(spark):
    df = frame(spark, {"a": weekly(120, slope=0.0), "b": weekly(100, 3, slope=0.0)})
    model = sequence.train(df, K, kind="trees", maxIter=5)
    rows = sequence.forecast(model, df, 7).collect()
    assert len(rows) == 14 and all(80 < r.yhat < 120 for r in rows)
    scored, metrics = sequence.evaluate_holdout(df, K)
    assert scored.count() == 16 and metrics.count() == 2


def test_refresh_equals_batch_with_late_rows_and_reruns(spark, tmp_path):
    source, target, progress = (str(tmp_path / x) for x in ("sales", "daily", "progress"))
    schema = "date date, product_id string, store_id string, sales_quantity double, unit_price double"
    first = [(DAY + timedelta(days=i), "P1", "S1", float(i), 1.0) for i in range(60)]
    late = [(DAY + timedelta(days=3), "P2", "S1", 100.0, 1.0), (DAY + timedelta(days=70), "P1", "S1", 7.0, 1.0)]
    for rows in (first, late, []):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        refresh.start_refresh(spark, source, target, progress).awaitTermination()
    got = {r.date: r.total_sales for r in refresh.read_daily(spark, target).collect()}
    assert len(got) == 61 and got[DAY + timedelta(days=3)] == 103.0 and got[DAY + timedelta(days=70)] == 7.0
    whole = spark.read.parquet(source)
    refresh.refresh_months(whole.limit(5), whole, target)  # repeating a batch changes nothing
    assert {r.date: r.total_sales for r in refresh.read_daily(spark, target).collect()} == got


def test_rolling_validation_of_short_histories(spark):
    """With no more rows than columns the priors keep acting."""
    rng = np.random.default_rng(11)
    days = pd.date_range("1999-01-01", periods=140).date
    wave = 170 + 40 * np.sin(2 * np.pi * np.arange(140) / 7) + rng.normal(0, 3, 140)
    series = spark.createDataFrame(pd.DataFrame({"date": days, "total_sales": wave}))
    rows = structural.with_effects(series)
    for mode in ("additive", "multiplicative"):
        parameters = {**structural.STRUCTURAL_DEFAULTS, "seasonality_mode": mode}
        rolled = structural.rolling_forecasts(rows, parameters).toPandas()
        error = (rolled["actual"] - rolled["predicted"]) ** 2
        assert float(np.sqrt(error.groupby(rolled["cutoff"]).mean()).max()) < 20, mode


def test_a_constant_and_a_zero_series_forecast_their_value(spark):
    days = pd.date_range("1999-01-01", periods=60).date
    rng = np.random.default_rng(3)
    parts = [("zero", np.zeros(60)), ("five", np.full(60, 5.0)), ("wave", 50 + 10 * np.sin(np.arange(60)) + rng.normal(0, 1, 60))]
    frame = pd.concat([pd.DataFrame({"product_id": k, "date": days, "total_sales": v}) for k, v in parts])
    series, keys = spark.createDataFrame(frame), ("product_id",)
    model = sequence.train(series, keys)
    got = sequence.forecast(model, series).toPandas().groupby("product_id")["yhat"].mean()
    assert abs(got["zero"]) < 1e-9 and abs(got["five"] - 5) < 1e-9 and len(got) == 3
    rows = structural.with_effects(series)
    fitted = structural.fit(rows, keys=keys)
    ahead = structural.with_effects(structural.future_dates(series, 7, keys).drop("step"))
    got = structural.predict(fitted, ahead, keys).toPandas().groupby("product_id")["yhat"].mean()
    assert abs(got["zero"]) < 1e-3 and abs(got["five"] - 5) < 0.05 and len(got) == 3


def test_arima_of_31_days_is_no_zero_vector(spark):
    days = pd.date_range("1999-01-01", periods=31).date
    wave = 60 + 10 * np.sin(2 * np.pi * np.arange(31) / 7)
    series = spark.createDataFrame(pd.DataFrame({"date": days, "total_sales": wave}))
    out = sarimax.train(series)
    yhat = out["forecast"].toPandas()["yhat"].to_numpy()
    assert len(yhat) == 7 and (yhat > 20).all() and (yhat < 120).all()
