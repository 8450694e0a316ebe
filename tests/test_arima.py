"""Exact likelihood and the one-pass seasonal ARIMA."""

from datetime import date, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from demandspark.operators import arima, diagnostics, sarimax
from demandspark.operators.likelihood import Likelihood, Order, from_partial, lag_weights, response
from demandspark.schema import ARIMA_DEFAULT_GRID, ARIMA_RUN_GRID

DAY = date(2020, 1, 1)
K = ("k",)
ORDERS = [Order(1), Order(0, 0, 1), Order(2, 0, 1), Order(1, 0, 1, 1, 0, 1), Order(2, 0, 2, 1, 0, 1), Order(0, 0, 0, 1, 0, 0), Order(0, 0, 2, 0, 0, 1)]


def frame(spark, series):
    rows = [(k, DAY + timedelta(days=i), float(v)) for k, ys in series.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "k string, date date, total_sales double")


def simulated(n, phi=0.0, theta=0.0, sphi=0.0, stheta=0.0, seed=0, m=7, level=50.0):
    ar, ma = (np.zeros(m + 2) for _ in "ab")
    ar[[1, m, m + 1]] = phi, sphi, -phi * sphi
    ma[[1, m, m + 1]] = theta, stheta, theta * stheta
    e = np.random.default_rng(seed).normal(size=n + 600)
    u = np.zeros(n + 600)
    for t in range(m + 1, n + 600):
        u[t] = e[t] + sum(ar[i] * u[t - i] + ma[i] * e[t - i] for i in (1, m, m + 1))
    return level + u[600:]


def by_covariance(order, u, w, x, m=7):
    """Likelihood from the whole covariance matrix of the series."""
    ar, ma = (a[0] for a in lag_weights(order, np.asarray(u)[None], m))
    psi, n = response(ar, ma, 8000), len(w)
    gamma = np.array([psi[: 8000 - k] @ psi[k:] for k in range(n)])
    cov = gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    inverse = np.linalg.inv(cov)
    beta = np.linalg.lstsq(x.T @ inverse @ x, x.T @ inverse @ w, rcond=None)[0] if x.shape[1] else np.zeros(0)
    left = w - x @ beta
    sigma2 = left @ inverse @ left / n
    return -0.5 * (n * (np.log(2 * np.pi * sigma2) + 1) + np.linalg.slogdet(cov)[1]), beta, sigma2


@pytest.mark.parametrize("order", ORDERS, ids=str)
@pytest.mark.parametrize("n", [30, 8])
def test_likelihood_equals_the_covariance_matrix(order, n):
    rng = np.random.default_rng(n)
    w, u = rng.normal(size=n).cumsum(), 0.6 * rng.normal(size=order.terms)
    for columns in range(3):
        x = np.column_stack([np.ones(n), rng.normal(size=n)])[:, :columns]
        found, (value, beta, sigma2) = Likelihood(order, w, x, 7).at(u), by_covariance(order, u, w, x)
        assert abs(found.log_likelihood - value) < 1e-6 and abs(found.sigma2 - sigma2) < 1e-6 * sigma2
        assert np.allclose(found.beta, beta, atol=1e-6)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-4, 4), min_size=1, max_size=4))
def test_every_trial_is_stable(u):
    ar = from_partial(np.array([u]))[0]
    companion = np.eye(len(ar), k=-1)
    companion[0] = ar
    assert np.abs(np.linalg.eigvals(companion)).max() < 1


def test_optimum_is_flat():
    w = simulated(300, 0.5, 0.3, 0.6, -0.2, seed=4)
    for columns in (np.ones((300, 1)), np.column_stack([np.ones(300), np.random.default_rng(1).normal(size=(300, 6))])):
        model = Likelihood(Order(1, 0, 1, 1, 0, 1), w, columns, 7)
        fit = model.maximise()
        near = fit.terms + 1e-3 * np.concatenate([np.eye(4), -np.eye(4)])
        assert (model.value(near) <= fit.log_likelihood + 1e-4).all()
        assert np.abs(model._slope(fit.terms)).max() < 0.2


def test_seasonal_terms_are_recovered_and_multiplied(spark):
    df = frame(spark, {f"s{i}": simulated(3000, 0.6, 0.3, 0.7, 0.4, seed=i) for i in range(3)})
    out = sarimax.fit_exact(df, K, regressors=False, select=(1, 0, 1, 1, 0, 1))
    for r in out["coefficients"].collect():
        assert np.allclose(r.terms, [0.6, 0.3, 0.7, 0.4], atol=0.1)
        assert abs(r.ar[7] + r.terms[0] * r.terms[2]) < 1e-9 and abs(r.ma[7] - r.terms[1] * r.terms[3]) < 1e-9
        assert abs(r.sigma2 - 1) < 0.1 and abs(r.beta[0] / (1 - sum(r.ar)) - 50) < 2
    spread = out["fitted"].groupBy("k").agg(F.avg("residual").alias("m"), F.stddev("residual").alias("s"), F.count("residual").alias("n"))
    for r in spread.collect():
        assert abs(r.m) < 0.05 and abs(r.s - 1.0) < 0.06 and r.n == 3000


def test_regressors_and_terms_are_fitted_together(spark):
    rng = np.random.default_rng(5)
    n = 1500
    df = frame(spark, {"a": simulated(n, 0.6, seed=2)})
    x = np.array([((i * 7919) % 11) / 11 - 0.5 for i in range(n)])
    rows = [("a", DAY + timedelta(days=i), float(50 + 4 * x[i] + u), [float(x[i])]) for i, u in enumerate(simulated(n, 0.6, seed=2, level=0.0))]
    rows += [("a", DAY + timedelta(days=n + i), None, [float(rng.normal())]) for i in range(3)]
    given_rows = spark.createDataFrame(rows, "k string, date date, value double, xreg array<double>")
    r = arima.fit_series(given_rows, K, ARIMA_RUN_GRID, 7, select=(1, 0, 0, 0, 0, 0)).first()
    assert abs(r.terms[0] - 0.6) < 0.06 and abs(r.beta[1] - 4) < 0.3 and len(r.yhat) == 3 and df.count() == n
    level, last = r.beta[0] / (1 - r.terms[0]), rows[n - 1]
    left = last[2] - level - r.beta[1] * last[3][0]
    want = [level + r.beta[1] * rows[n + i][3][0] + left * r.terms[0] ** (i + 1) for i in range(3)]
    assert np.allclose(r.yhat, want, atol=1e-6)
    half = [1.96 * np.sqrt(r.sigma2 * sum(r.terms[0] ** (2 * j) for j in range(i + 1))) for i in range(3)]
    assert np.allclose(np.array(r.upper) - r.yhat, half)


def test_short_series_have_orders_residuals_and_forecasts(spark):
    series = {f"n{n}": simulated(n, 0.5, seed=n) for n in (1, 3, 4, 7, 8, 9, 12, 20, 40)}
    series |= {"flat": np.full(30, 5.0), "zero": np.zeros(12)}
    df = frame(spark, series)
    out = sarimax.fit_exact(df, K)
    orders = {r.k: r for r in out["orders"].collect()}
    assert {k: r.status for k, r in orders.items() if r.n < 4} == {"n1": "too short", "n3": "too short"}
    assert {orders[k].status for k in ("n4", "n7")} == {"level"}
    assert {orders[k].status for k in ("n8", "n12")} == {"without regressors"}
    # no candidate of the nine rows is stable
    assert orders["n9"].status == "level" and orders["n40"].status == "fitted"
    assert all(r.p + r.q > 0 and r.seasonal_p + r.seasonal_q > 0 for r in orders.values() if r.n >= 8 and r.status != "level")
    ahead = out["forecast"].groupBy("k").agg(F.count("yhat").alias("n"), F.max(F.isnan("yhat")).alias("bad"), F.avg("yhat").alias("m")).collect()
    assert {r.k: r.n for r in ahead} == {k: 7 for k in series if k not in ("n1", "n3")} and not any(r.bad for r in ahead)
    level = {r.k: r.m for r in ahead}
    assert abs(level["flat"] - 5) < 1e-6 and abs(level["zero"]) < 1e-6 and abs(level["n4"] - series["n4"].mean()) < 1e-9
    got = {r.k: (r.n, r.known) for r in out["fitted"].groupBy("k").agg(F.count("*").alias("n"), F.count("residual").alias("known")).collect()}
    assert got == {k: (len(v), len(v) if len(v) >= 4 else 0) for k, v in series.items()}


def test_every_candidate_of_every_series_has_a_row(spark):
    df = frame(spark, {"a": simulated(60, 0.5), "b": simulated(9, 0.5), "c": [1.0]})
    got = sarimax.search_orders(df, K)
    assert {r.k: r["count"] for r in got.groupBy("k").count().collect()} == {"a": 96, "b": 96, "c": 96}
    for r in got.filter("k <> 'c'").collect():
        n = {"a": 60, "b": 9}[r.k]
        assert r.n_eff == max(n - r.d - 7 * r.seasonal_d, 0)
        assert r.grid_id == r.p + 3 * (r.d + 2 * (r.q + 3 * (r.seasonal_p + 2 * (r.seasonal_d + 2 * r.seasonal_q))))


def test_folds_from_running_sums_equal_separate_fits(spark):
    y = simulated(160, 0.6, 0.2, 0.4, seed=3)
    folds = arima.expanding_units(5)(None, 160, 160)
    assert folds == [(i, 160 - (5 - i + 1) * 32, 160 - (5 - i) * 32) for i in range(2, 6)]
    whole = arima.Screen(y, [c for _, c, _ in folds], ARIMA_DEFAULT_GRID, 7)
    for _, count, _ in folds:
        alone = arima.Screen(y[:count], [count], ARIMA_DEFAULT_GRID, 7)
        for order in (Order(1, 0, 1, 1, 0, 0), Order(2, 1, 0, 0, 1, 1), Order(0, 0, 3, 2, 0, 2)):
            assert np.allclose(whole.score(count, order), alone.score(count, order), rtol=1e-8)
    df = frame(spark, {"a": y})
    rows = sarimax.with_design(df.withColumnRenamed("total_sales", "value"), regressors=False)
    together = {r.unit: r for r in arima.fit_series(rows, K, ARIMA_DEFAULT_GRID, 7, arima.expanding_units(5), "auto").collect()}
    for number, count, stop in folds:
        part = rows.withColumn("value", F.when(F.col("date") < F.lit(DAY + timedelta(days=count)), F.col("value"))).filter(F.col("date") < F.lit(DAY + timedelta(days=stop)))
        single = arima.fit_series(part, K, ARIMA_DEFAULT_GRID, 7, select="auto").first()
        assert [together[number][c] for c in sarimax.ORDERS] == [single[c] for c in sarimax.ORDERS]
        assert np.allclose(together[number].yhat, single.yhat, rtol=1e-7)


def test_differencing_is_chosen_by_the_tests(spark):
    rng = np.random.default_rng(6)
    walk, wave = 100 + rng.normal(size=400).cumsum(), 100 + 10 * np.sin(2 * np.pi * np.arange(400) / 7) + rng.normal(size=400)
    series = {"noise": rng.normal(size=400), "walk": walk, "wave": wave, "twice": rng.normal(size=400).cumsum().cumsum()}
    got = {k: arima.differencing(np.asarray(v), ARIMA_DEFAULT_GRID, 7) for k, v in series.items()}
    assert got["noise"] == (0, 0) and got["walk"][0] == 1 and got["wave"][1] == 1 and got["twice"][0] == 2
    df = frame(spark, series)
    for r in diagnostics.kpss(df, keys=K).collect():
        assert abs(r.statistic - arima.kpss_level(np.asarray(series[r.k]))) < 1e-9 and r.stationary == (r.k in ("noise", "wave"))
    for r in diagnostics.seasonal_strength(df, keys=K).collect():
        assert abs(r.strength - arima.seasonal_strength(np.asarray(series[r.k]), 7)) < 1e-9 and r.seasonal == (r.k == "wave")
    rows = diagnostics.kpss(frame(spark, {"flat": [3.0] * 10, "one": [4.0]}), keys=K).collect()
    assert all(r.statistic == 0 and r.stationary for r in rows)


def test_neighbour_steps_find_the_order(spark):
    df = frame(spark, {"ar": simulated(1200, 0.7, seed=1), "season": simulated(1200, 0.0, 0.0, 0.6, seed=2)})
    for exact in (True, False):
        got = {r.k: r for r in sarimax.auto_orders(df, K, period=7, exact=exact).collect()}
        assert got["ar"].p + got["ar"].q >= 1 and got["ar"].d == 0
        assert got["season"].seasonal_p + got["season"].seasonal_q >= 1
    scores = {Order(p, 0, q): abs(p - 3) + abs(q - 1) + 0.1 for p in range(4) for q in range(4)}
    assert arima.stepwise(lambda o: scores[o], 0, 0, ARIMA_DEFAULT_GRID, False)[0] == Order(3, 0, 1)


def test_two_rows_of_a_date_are_an_error(spark):
    df = frame(spark, {"a": simulated(20)})
    with pytest.raises(Exception, match="do not identify a row"):
        sarimax.search_orders(df.unionByName(df.limit(1)), K).collect()


def test_empty_and_null_series(spark):
    df = frame(spark, {"a": simulated(20)})
    assert sarimax.fit_exact(df.limit(0), K)["forecast"].count() == 0
    nulls = df.withColumn("total_sales", F.when(F.col("date") < "2020-01-15", F.lit(None)).otherwise(F.col("total_sales")))
    assert sarimax.fit_exact(nulls, K)["orders"].first().n == 6
    assert sarimax.fit_exact(df.withColumn("total_sales", F.lit(None).cast("double")), K)["orders"].count() == 0
