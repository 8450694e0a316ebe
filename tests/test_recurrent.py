"""The recurrent network: its gradient, its learning and what it gives in defined cases."""

from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from demandspark.operators import recurrent, sequence

DAY = date(2020, 1, 1)
K = ("k",)


def frame(spark, series: dict):
    rows = [(k, DAY + timedelta(days=i), None if v is None else float(v)) for k, ys in series.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "k string, date date, total_sales double")


def parabola(n, x):
    """A chaotic series that a straight line cannot foretell and its square can."""
    out = []
    for _ in range(n):
        out.append(100 * x)
        x = 3.9 * x * (1 - x)
    return out


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(5)
    units, x, y = 3, rng.normal(size=(6, 5)), rng.normal(size=6)
    weights = recurrent.initial(units, 1) + 0.1 * rng.normal(size=recurrent.initial(units, 1).size)
    for masks in ((1.0, 1.0), recurrent.masks_of(np.arange(6, dtype=np.uint64), 2, 5, units, 0.3)):
        loss = lambda w: ((recurrent.forward(w, units, x, masks)[0] - y) ** 2).sum()  # noqa: B023, E731
        want = np.array([(loss(weights + e) - loss(weights - e)) / 2e-5 for e in 1e-5 * np.eye(weights.size)])
        assert np.allclose(recurrent.gradient(weights, units, x, y, masks)[0], want, atol=1e-6)


def test_units_left_out_depend_on_the_window_alone():
    ids = np.arange(4000, dtype=np.uint64) * np.uint64(7919)
    steps, last = recurrent.masks_of(ids, 3, 7, 4, 0.25)
    assert steps.shape == (7, 4000, 4) and abs((steps == 0).mean() - 0.25) < 0.01 and abs(last.mean() - 1) < 0.02
    again = recurrent.masks_of(ids[100:200], 3, 7, 4, 0.25)
    assert np.array_equal(again[0], steps[:, 100:200]) and np.array_equal(again[1], last[100:200])
    assert not np.array_equal(recurrent.masks_of(ids, 4, 7, 4, 0.25)[1], last)


def test_a_nonlinear_series_is_learnt_where_a_line_fails(spark):
    df = frame(spark, {"a": parabola(300, 0.31), "b": parabola(300, 0.57), "flat": [5.0] * 40, "short": [1.0, 2.0]})
    line = {r.split: r.mse for r in sequence.train(df, K).errors.collect()}
    model = sequence.train(df, K, kind="recurrent", epochs=80, dropout=0.0, rate=0.03)
    errors = {r.split: r for r in model.errors.collect()}
    assert errors["validation"].mse < 0.5 * line["validation"]
    assert errors["train"].n == 2 * int(0.8 * 293)
    history = {r.epoch: r.mse for r in model.history.filter("split = 'train'").collect()}
    assert sorted(history) == list(range(81)) and history[80] < 0.5 * history[0]

    got = sequence.forecast(model, df, 3)
    assert {(r.k, r.n) for r in got.groupBy("k").agg(F.count("yhat").alias("n")).collect()} == {
        (k, 3) for k in ("a", "b", "flat", "short")}
    assert {r.yhat for r in got.filter("k = 'flat'").collect()} == {5.0}
    ys = np.array(parabola(300, 0.31))
    mean, sd = ys.mean(), ys.std(ddof=1)
    state, want = list((ys[-7:] - mean) / sd), []
    for _ in range(3):
        state.append(model.regressor.predict(np.array([state[-7:]]))[0])
        want.append(state[-1] * sd + mean)
    assert np.allclose([r.yhat for r in got.filter("k = 'a'").orderBy("date").collect()], want)


def test_weights_do_not_depend_on_the_partitioning(spark):
    windows = sequence.training_windows(frame(spark, {"a": parabola(60, 0.2), "b": parabola(50, 0.4)}), K).cache()
    one, many = (recurrent.fit(windows.repartition(n), ["k", "date"], 7, units=4, epochs=5)[0].weights for n in (1, 6))
    assert np.allclose(one, many, atol=1e-9) and not np.allclose(one, recurrent.initial(4, 7))


def test_nothing_to_learn_from_and_numbers_missing(spark):
    for series in ({}, {"flat": [3.0] * 20}, {"short": [1.0, 4.0]}):
        df = frame(spark, series)
        model = sequence.train(df, K, kind="recurrent", units=2, epochs=3)
        assert model.errors.count() == 0 and not model.regressor.weights.any()
        got = sequence.forecast(model, df, 2).collect()
        assert len(got) == 2 * len(series) and all(r.yhat == np.mean(series[r.k]) for r in got)
    holes = parabola(40, 0.3)
    holes[12], holes[-2] = None, None
    df = frame(spark, {"holes": holes, "whole": parabola(40, 0.6)})
    model = sequence.train(df, K, kind="recurrent", units=2, epochs=2)
    assert sum(r.n for r in model.errors.collect()) < 66
    got = {r.k: r.n for r in sequence.forecast(model, df, 2).groupBy("k").agg(F.count("yhat").alias("n")).collect()}
    assert got == {"holes": 0, "whole": 2}


def test_run_and_holdout(spark):
    df = frame(spark, {"a": parabola(60, 0.2), "b": parabola(50, 0.4)})
    out = sequence.run(df, K, kind="recurrent", units=4, epochs=3)
    assert out["history"].count() == 2 * 4 and out["forecast"].count() == 14
    assert out["holdout"].count() == 16 and out["metrics"].count() == 2
