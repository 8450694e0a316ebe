"""Laplace changepoints, running Gram matrices and simulated intervals of the structural model."""

from datetime import date, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from demandspark.operators import structural
from demandspark.schema import STRUCTURAL_DEFAULTS

DAY = date(2020, 1, 1)
K = ("k",)


def frame(spark, series):
    rows = [(k, DAY + timedelta(days=i), float(v)) for k, ys in series.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "k string, date date, total_sales double")


def objective(g, b, weight, x):
    return 0.5 * x @ g @ x - b @ x + weight * np.abs(x).sum()


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10**6), st.floats(0.01, 30.0), st.booleans())
def test_lasso_is_optimal(k, seed, weight, collinear):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(k + 4, k))
    if collinear:  # as hinges with near knots are
        a = np.cumsum(np.maximum(a, 0), axis=1)
    g, b = a.T @ a, a.T @ rng.normal(size=k + 4) * 3
    x = structural.lasso(g, b, weight)
    slope = g @ x - b
    scale = 1e-7 * max(weight, np.abs(b).max())
    assert np.abs(slope[x != 0] + weight * np.sign(x[x != 0])).max(initial=0) <= scale
    assert (np.abs(slope[x == 0]) - weight).max(initial=0) <= scale
    for _ in range(20):
        assert objective(g, b, weight, x) <= objective(g, b, weight, x + rng.normal(size=k) * 0.05) + 1e-9 * max(1, np.abs(b).max())


def test_one_break_gives_few_changepoints(spark):
    rng = np.random.default_rng(3)
    t = np.arange(400)
    y = 100 + 0.2 * t + 1.0 * np.maximum(t - 160, 0) + 5 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 2, 400)
    df = frame(spark, {"a": y, "line": 100 + 0.5 * t + rng.normal(0, 2, 400)})
    rows = structural.with_effects(df)
    mode = {**STRUCTURAL_DEFAULTS, "seasonality_mode": "additive"}
    fits = {r.k: r for r in structural.fit(rows, mode, K, prior="laplace").collect()}
    assert all(r.breach < 1e-6 for r in fits.values())
    points = structural.changepoints(structural.fit(rows, mode, K, prior="laplace"), K).collect()
    large = [r for r in points if r.k == "a" and abs(r.delta) > 0.05]
    assert 1 <= len(large) <= 4 and all(abs((r.date - DAY).days - 160) <= 35 for r in large)
    assert abs(sum(r.delta for r in points if r.k == "a") - 1.0) < 0.15
    assert sum(r.delta == 0 for r in points) >= 30
    smooth = [r for r in structural.changepoints(structural.fit(rows, mode, K), K).collect() if r.delta == 0]
    assert not smooth


@pytest.mark.parametrize("gaps", [False, True])
def test_running_gram_equals_the_rows(gaps):
    rng = np.random.default_rng(9)
    day = np.arange(300) if not gaps else np.sort(rng.choice(900, 300, replace=False))
    y, effects = rng.normal(50, 9, 300), rng.normal(size=(300, 24))
    running = structural.RunningGram(day + 7000, y, effects)
    for n in (2, 20, 21, 140, 299, 300):
        t = (day[:n] - day[0]) / max(day[n - 1] - day[0], 1)
        x = np.hstack([structural._trend_design(t), effects[:n]])
        g, xty, yty = running.upto(n)
        assert np.allclose(g, x.T @ x, rtol=1e-9, atol=1e-8) and np.allclose(xty, x.T @ y[:n], rtol=1e-9, atol=1e-7)
        assert abs(yty - y[:n] @ y[:n]) < 1e-6
    with pytest.raises(ValueError):
        running.upto(5)


def test_interval_covers_what_it_says(spark):
    """Paths as the model has them, with changepoints in the first 80% of the history and in the future."""
    rng, n, h = np.random.default_rng(12), 330, 14
    series, future = {}, {}
    for s in range(60):
        change = np.where(rng.random(n + h) < 25 / (0.8 * n), rng.laplace(0, 0.1, n + h), 0.0)
        change[int(0.8 * n): n] = 0.0
        slopes = 0.2 + np.cumsum(change)
        y = 300 + np.cumsum(slopes) + rng.normal(0, 1.5, n + h)
        series[f"s{s}"], future[f"s{s}"] = y[:n], y[n:]
    df = frame(spark, series)
    run = lambda: structural.train(df, K, horizon=h, optimise=False, samples=300)["forecast"].orderBy("k", "date").collect()
    rows = run()
    assert [(r.k, r.lower, r.upper) for r in rows] == [(r.k, r.lower, r.upper) for r in run()]
    hit = [r.lower <= future[r.k][(r.date - DAY).days - n] <= r.upper for r in rows]
    assert len(hit) == 60 * h and 0.7 < np.mean(hit) < 0.9
    width = {}
    for r in rows:
        width.setdefault((r.date - DAY).days - n, []).append(r.upper - r.lower)
    assert np.mean(width[h - 1]) > np.mean(width[0])


def test_null_values_and_empty_tables(spark):
    t = np.arange(80)
    df = frame(spark, {"a": 50 + t, "none": 50 + t}).withColumn("total_sales", F.when((F.col("k") == "a") & (F.dayofmonth("date") != 5), F.col("total_sales")))
    rows = structural.with_effects(df)
    got = structural.fit(rows, keys=K).collect()
    assert [r.k for r in got] == ["a"] and got[0].first == DAY and got[0].y_scale == 129
    assert structural.fit(rows.limit(0), keys=K, prior="laplace").count() == 0
    assert structural.rolling_forecasts(rows, keys=K).filter("k = 'none'").count() == 0
