"""Seasonal ARIMA with regressors for many series.

``train``, ``evaluate_holdout``, ``cross_validate`` and the order searches take one pass over each
series (``arima``): orders by two-stage least squares or exact likelihood, the fit always by exact
likelihood. ``fit`` and ``forecast`` are the two-stage fit of given orders by distributed Gram
matrices, for series too long for one task.

Hannan and Rissanen (1982): a long autoregression gives innovations, then the
ARMA terms are one regression on lagged values and lagged innovations.
Innovations are linear in the lagged values, so one Gram matrix of the lag
vector (1, w[t-H], ..., w[t]) determines the long autoregression, the
innovations and, because differencing is linear too, every candidate of every
differencing: a grid of any size is one pass over the rows.
Its seasonal terms enter as lags m, 2m, ... . Estimates differ from exact maximum
likelihood.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandspark.functions.calendar import Holidays
from demandspark.functions.metrics import evaluate
from demandspark.operators import arima
from demandspark.operators.diagnostics import ljung_box, shapiro_wilk
from demandspark.operators.gram import (
    attach,
    dot,
    gram_partials,
    key_fields,
    least_squares,
    solve_per_series,
    spread,
)
from demandspark.operators.grids import ORDER_COLUMNS, best_candidate
from demandspark.operators.lags import (
    ar_lags,
    candidates,  # noqa: F401
    difference_weights,
    innovation_basis,
    lagged_basis,
    largest_root,
    pick_lag,
)
from demandspark.operators.panel import (
    future_dates,
    last_rows,
    series_window,
    whole_series,
)
from demandspark.operators.regressors import calendar_regressors, design_matrix
from demandspark.session import cut_lineage
from demandspark.schema import (
    ARIMA_DEFAULT_GRID,
    ARIMA_RUN_GRID,
    HOLDOUT_DAYS,
    HORIZON,
    MODEL_HOLIDAYS,
    SEASONAL_PERIOD,
    TOTAL,
)

LONG_AR = arima.LONG_AR
Z95 = 1.96
# relative ridge where a series has no more rows than its order has columns
SHORT_RIDGE = 0.1
ORDERS = list(ORDER_COLUMNS.values())
MODEL = "arima"

DOUBLES = T.ArrayType(T.DoubleType())
ORDER_FIELDS = [T.StructField(c, T.IntegerType()) for c in ORDERS]


def _combine(weights: Mapping[int, float], lagged: Mapping[int, Column]) -> Column:
    return sum((lagged[lag] * c for lag, c in weights.items() if lag), lagged[0])


def _without_design(series: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return with_design(series.select(*keys, "date", F.col(value).cast("double").alias("value")), regressors=False)


def search_orders(
    series: DataFrame,
    keys: Sequence[str] = TOTAL,
    value: str = "total_sales",
    limits: Mapping[str, int] = ARIMA_RUN_GRID,
    period: int | None = SEASONAL_PERIOD,
) -> DataFrame:
    """Two-stage AIC of every candidate order of every series, scaled to all rows of the series.

    ``n_eff`` rows are left after differencing. A candidate that has too few for its columns, or whose
    AR or MA part is unstable, scores infinity.
    """
    rows = _without_design(series, keys, value)
    fits = arima.fit_series(rows, keys, limits, period, select="grid", keep=("grid",), fit=False)
    scored = arima.exploded(fits, keys, "grid", ("grid_id", "n_eff", "sigma2", "aic"))
    step, columns = 1, []
    for name, column in ORDER_COLUMNS.items():
        size = limits[name] + 1 if period or name.islower() else 1
        columns.append(F.expr(f"CAST(grid_id DIV {step} % {size} AS INT)").alias(column))
        step *= size
    return scored.select(*keys, "grid_id", *columns, "n_eff", "sigma2", "aic")


def best_orders(scored: DataFrame, keys: Sequence[str] = TOTAL) -> DataFrame:
    return best_candidate(scored, "aic", keys)


def auto_orders(
    series: DataFrame,
    keys: Sequence[str] = TOTAL,
    value: str = "total_sales",
    limits: Mapping[str, int] = ARIMA_DEFAULT_GRID,
    period: int | None = None,
    exact: bool = True,
) -> DataFrame:
    """(keys, orders, status, n, score): differencing by tests, then neighbour steps, for every series.

    A strong season asks for a seasonal difference, a level that is not stationary for plain ones.
    Neighbours are compared by corrected AIC of the exact likelihood, or, with ``exact`` off, by
    two-stage AIC. Non-seasonal unless a period is given.
    """
    rows = _without_design(series, keys, value)
    fits = arima.fit_series(rows, keys, limits, period, select="exact" if exact else "auto", keep=(), fit=False)
    return fits.select(*keys, *ORDERS, "status", "n", "score")


def with_design(series: DataFrame, holidays: Holidays = MODEL_HOLIDAYS, regressors: bool = True) -> DataFrame:
    """(…, x): the calendar design columns, or none."""
    if regressors:
        return design_matrix(calendar_regressors(series, holidays), name="xreg")
    return series.withColumn("xreg", F.array().cast("array<double>"))


def _differenced_rows(
    rows: DataFrame, keys: Sequence[str], limits: Mapping[str, int], m: int, backcast: bool = False
) -> DataFrame:
    """Adds ``w`` and ``dx``: value and regressors differenced by the row's own order.

    Needs value, xreg, d, seasonal_d; NULL where the history is too short, or with
    ``backcast`` as if the series had been at its first row before. ``started`` then
    says which rows need none.
    """
    orders = [(i, j) for i in range(limits["d"] + 1) for j in range(limits["D"] + 1)]
    weights = {o: difference_weights(*o, m) for o in orders}
    back = sorted({lag for c in weights.values() for lag in c} - {0})
    w = series_window(keys)
    if backcast:
        rows = rows.withColumn("_at", F.row_number().over(w))

    def earlier(c: str, n: int) -> Column:
        known = F.lag(c, n).over(w)
        return F.when(F.col("_at") <= n, F.first(c).over(w)).otherwise(known) if backcast else known

    rows = rows.withColumns(
        {f"_y{n}": earlier("value", n) for n in back} | {f"_x{n}": earlier("xreg", n) for n in back}
    )
    values = {0: F.col("value"), **{n: F.col(f"_y{n}") for n in back}}

    def regressors(c: Mapping[int, float]) -> Column:
        if len(c) == 1:
            return F.col("xreg")
        return F.transform(
            "xreg", lambda v, i: sum((F.col(f"_x{n}")[i] * x for n, x in c.items() if n), v))

    chosen_w, chosen_x = F, F
    for (d, sd), c in weights.items():
        own = (F.col("d") == d) & (F.col("seasonal_d") == sd)
        chosen_w = chosen_w.when(own, _combine(c, values))
        chosen_x = chosen_x.when(own, regressors(c))
    dropped = [f"_{kind}{n}" for kind in "xy" for n in back]
    if backcast:
        rows = rows.withColumn("started", F.col("_at") > F.col("d") + m * F.col("seasonal_d"))
        dropped.append("_at")
    return rows.withColumn("w", chosen_w).withColumn("dx", chosen_x).drop(*dropped)


def fit(
    train: DataFrame,
    orders: DataFrame,
    keys: Sequence[str] = TOTAL,
    value: str = "total_sales",
    limits: Mapping[str, int] = ARIMA_RUN_GRID,
    period: int | None = SEASONAL_PERIOD,
    long_ar: int = LONG_AR,
) -> tuple[DataFrame, DataFrame]:
    """Each series at its own order, regressors and ARMA terms in one regression.

    ``train`` is (keys, date, value, xreg). Gives (coefficients, rows): one row
    per series with beta (constant first), ar, ma and sigma2, and one row per
    date with value, differenced value and residual. The fit is over the rows
    with full history; residuals before them take the first value for what the
    differences lack and the mean of the differenced series for the lags. A
    series shorter than the lag vector has no coefficients and NULL residuals.
    """
    m = period or 1
    limits = {k: v if period or k.islower() else 0 for k, v in limits.items()}
    ar, ma = ar_lags((limits["p"], limits["P"]), m), ar_lags((limits["q"], limits["Q"]), m)
    span = long_ar + max([1, *ar, *ma])
    ordered = attach(
        spread(train.select(*keys, "date", F.col(value).cast("double").alias("value"), "xreg"), keys),
        orders.select(*keys, *ORDERS), keys,
    )
    rows = _differenced_rows(ordered, keys, limits, m, backcast=True).filter("w IS NOT NULL AND dx IS NOT NULL")
    recent = series_window(keys).rowsBetween(-span, 0)
    rows = rows.withColumns({
        "_recent": F.collect_list("w").over(recent),
        "_full": F.count(F.when(F.col("started"), 1)).over(recent) == span + 1,
        "_mean": F.avg("w").over(whole_series(keys)),
    })
    before = F.array_repeat("_mean", span + 1 - F.size("_recent"))
    every = rows.select(
        *keys, "date", "value", *ORDERS, "w", F.concat(F.array(F.lit(1.0)), before, "_recent", "dx").alias("x"),
        F.col("w").alias("y"), "_full",
    )
    design = every.filter("_full").drop("_full")

    def solver(key, n, g, _xty, _yty):
        """Sub-block of the series' own order, shrunk to stability if need be."""
        width, head = len(g), span + 2
        own_ar = ar_lags((key["p"], key["seasonal_p"]), m)
        own_ma = ar_lags((key["q"], key["seasonal_q"]), m)
        e = innovation_basis(g[:head, :head], n, span, long_ar)
        terms = [pick_lag(span, x) for x in own_ar] + [lagged_basis(e, x) for x in own_ma]
        terms = [np.concatenate([t, np.zeros(width - head)]) for t in terms]
        # the constant belongs to undifferenced series only
        outside = [0] if key["d"] + key["seasonal_d"] == 0 else []
        outside += range(head, width)
        basis = np.column_stack([np.eye(width)[:, outside], *terms])
        now = np.eye(width)[span + 1]
        # with no more rows than columns the regressors give way, then the ridge decides
        while len(outside) > 1 and n <= basis.shape[1] + 1:
            outside = outside[:1] if outside[0] == 0 else []
            basis = np.column_stack([np.eye(width)[:, outside], *terms])
        arma = np.zeros(len(terms))
        if terms:
            ridge = None if n > basis.shape[1] + 1 else np.diag(basis.T @ g @ basis) * SHORT_RIDGE
            arma = least_squares(basis.T @ g @ basis, basis.T @ g @ now, ridge)[len(outside):]
        dense = {"ar": np.zeros(max([1, *ar])), "ma": np.zeros(max([1, *ma]))}
        parts = (("ar", own_ar, arma[: len(own_ar)], 1.0), ("ma", own_ma, arma[len(own_ar):], -1.0))
        for name, lags, part, sign in parts:
            root = largest_root(lags, sign * part)
            shrink = 0.99 / root if root >= 1.0 else 1.0
            for lag, c in zip(lags, part):
                dense[name][lag - 1] = c * shrink**lag
        kept = [dense["ar"][x - 1] for x in own_ar] + [dense["ma"][x - 1] for x in own_ma]
        noise = now - sum((c * t for c, t in zip(kept, terms)), np.zeros(width))
        # constant and regressors given the ARMA part (the same numbers unless it was shrunk)
        weights = np.zeros(width)
        if outside:
            weights[outside] = least_squares(g[np.ix_(outside, outside)], g[outside] @ noise)
        noise = noise - weights
        beta = np.concatenate([weights[:1], weights[head:]])
        return [(dense["ar"], dense["ma"], beta, noise, float(max(noise @ g @ noise, 0.0)) / n, n)]

    fields = [
        *[T.StructField(c, DOUBLES) for c in ("ar", "ma", "beta", "noise")],
        T.StructField("sigma2", T.DoubleType()),
        T.StructField("n_eff", T.LongType()),
    ]
    keyed = [*keys, *ORDERS]
    # read several times below: written once, so no later step repeats the solve
    solved = cut_lineage(solve_per_series(gram_partials(design, keyed), keyed, solver, fields))
    noise = solved.select(*keys, "noise")
    every = every.drop(*ORDERS, "_full")
    every = every.join(noise, list(keys), "left") if keys else attach(every, noise, keys)
    fitted = every.select(*keys, "date", "value", "w", dot(F.col("noise"), F.col("x")).alias("residual"))
    return solved.drop("noise"), fitted


def forecast(
    coefficients: DataFrame,
    fitted: DataFrame,
    history: DataFrame,
    future: DataFrame,
    keys: Sequence[str] = TOTAL,
    limits: Mapping[str, int] = ARIMA_RUN_GRID,
    period: int | None = SEASONAL_PERIOD,
    model: str = MODEL,
) -> DataFrame:
    """(keys, model, date, yhat, lower, upper) for the rows of ``future``.

    ``history`` and ``future`` are (keys, date, xreg). One small row per series
    goes to Python: its last values, coefficients and future regression part.
    """
    m = period or 1
    limits = {k: v if period or k.islower() else 0 for k, v in limits.items()}
    names = list(keys)
    keep = 2 * m + 8
    points = F.sort_array(F.collect_list(F.struct("date", "value", "w", "residual")))
    tail = last_rows(fitted, keep, keys).groupBy(*keys).agg(points.alias("_p")).select(
        *keys, *[F.col(f"_p.{c}").alias(c) for c in ("value", "w", "residual")]
    )
    # differences of future regressors reach back into the last known rows
    known = last_rows(history.select(*keys, "date", "xreg"), keep, keys).withColumn("_ahead", F.lit(False))
    both = known.unionByName(future.select(*keys, "date", "xreg").withColumn("_ahead", F.lit(True)))
    placed = attach(
        both.withColumn("value", F.lit(0.0)), coefficients.select(*keys, "beta", "d", "seasonal_d"), keys)
    ahead = _differenced_rows(placed, keys, limits, m).filter("_ahead").withColumn(
        "xb", dot(F.col("beta"), F.concat(F.array(F.lit(1.0)), "dx")))
    steps = F.sort_array(F.collect_list(F.struct("date", "xb")))
    ahead = ahead.groupBy(*keys).agg(steps.alias("_f")).select(
        *keys, F.col("_f.date").alias("dates"), F.col("_f.xb").alias("xb")
    )
    state = attach(attach(tail, coefficients, keys), ahead, keys)

    def recurse(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                diff = difference_weights(row["d"], row["seasonal_d"], m)
                y, w, e = list(row["value"]), list(row["w"]), list(row["residual"])
                ar, ma = row["ar"], row["ma"]
                # psi weights of the undifferenced process give the interval
                psi, total = [1.0], 0.0
                full = np.convolve(
                    np.concatenate([[1.0], -ar]),
                    [diff.get(i, 0.0) for i in range(max(diff) + 1)],
                )
                for step, (day, xb) in enumerate(zip(row["dates"], row["xb"])):
                    nxt = xb + sum(c * w[-1 - i] for i, c in enumerate(ar) if c and i < len(w))
                    nxt += sum(c * e[-1 - i] for i, c in enumerate(ma) if c and i < len(e))
                    yhat = float(nxt - sum(c * y[-lag] for lag, c in diff.items() if 0 < lag <= len(y)))
                    w.append(nxt)
                    y.append(yhat)
                    e.append(0.0)
                    if step:
                        theta = ma[step - 1] if step <= len(ma) else 0.0
                        psi.append(theta - sum(
                            full[i] * psi[step - i] for i in range(1, min(step, len(full) - 1) + 1)))
                    total += psi[step] ** 2
                    half = Z95 * float(np.sqrt(row["sigma2"] * total))
                    out.append((*[row[k] for k in names], model, day, yhat, yhat - half, yhat + half))
            yield pd.DataFrame(out, columns=[*names, "model", "date", "yhat", "lower", "upper"])

    schema = T.StructType(
        [
            *key_fields(coefficients, keys),
            T.StructField("model", T.StringType()),
            T.StructField("date", T.DateType()),
            *[T.StructField(c, T.DoubleType()) for c in ("yhat", "lower", "upper")],
        ]
    )
    return state.mapInPandas(recurse, schema)


def _ahead(fits: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    found = arima.exploded(fits, keys, "ahead", ("date", "actual", "yhat", "lower", "upper"), extra)
    return found.withColumn("model", F.lit(MODEL))


def cross_validate(
    series: DataFrame,
    keys: Sequence[str] = TOTAL,
    k: int = 5,
    limits: Mapping[str, int] = ARIMA_DEFAULT_GRID,
    period: int | None = SEASONAL_PERIOD,
    holidays: Holidays = MODEL_HOLIDAYS,
    regressors: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(per-fold metrics, their averages per series) over expanding windows.

    Orders and coefficients of a fold come from its training rows only. Every fold with training rows has a
    row. One whose training rows are too few for any fit has n = 0, NULL metrics and ``fitted``
    false; averages are over the others.
    """
    rows = with_design(series, holidays, regressors).withColumnRenamed("total_sales", "value")
    fits = cut_lineage(arima.fit_series(
        rows, keys, limits, period, arima.expanding_units(k), "auto", ("ahead",)).withColumnRenamed("unit", "fold"))
    keyed = [*keys, "fold"]
    scored = evaluate(_ahead(fits, keys, ["fold"]).withColumnRenamed("yhat", "predicted"), keyed)
    spine = fits.select(*keyed, F.col("n_ahead").alias("n_test"))
    per_fold = spine.join(scored.withColumn("fitted", F.lit(True)), keyed, "left").withColumns(
        {c: F.coalesce(c, F.lit(empty)) for c, empty in (("n", 0), ("n_undefined", 0), ("fitted", False))})
    averages = per_fold.groupBy(*keys).agg(
        F.count(F.when(F.col("fitted"), 1)).alias("folds"),
        *[F.avg(c).alias(f"avg_{c}") for c in ("rmse", "mae", "mape")],
    )
    return per_fold, averages


def evaluate_holdout(
    series: DataFrame,
    keys: Sequence[str] = TOTAL,
    days: int = HOLDOUT_DAYS,
    limits: Mapping[str, int] = ARIMA_DEFAULT_GRID,
    period: int | None = SEASONAL_PERIOD,
    holidays: Holidays = MODEL_HOLIDAYS,
    regressors: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(scored rows, metrics per series) on the dates at or after last - days."""
    rows = with_design(series, holidays, regressors).withColumnRenamed("total_sales", "value")
    fits = arima.fit_series(rows, keys, limits, period, arima.holdout_unit(days), "auto", ("ahead",))
    scored = cut_lineage(_ahead(fits, keys).select(*keys, "model", "date", "actual", F.col("yhat").alias("predicted")))
    return scored, evaluate(scored, [*keys, "model"])


def fit_exact(
    series: DataFrame,
    keys: Sequence[str] = TOTAL,
    horizon: int = HORIZON,
    holidays: Holidays = MODEL_HOLIDAYS,
    regressors: bool = True,
    select: str | Sequence[int] = "grid",
    limits: Mapping[str, int] = ARIMA_RUN_GRID,
    period: int | None = SEASONAL_PERIOD,
) -> dict[str, DataFrame]:
    """Orders, coefficients, fitted rows and forecast of every series, from one pass over it.

    ``select`` is ``grid``, ``auto``, ``exact`` or one order (p, d, q, P, D, Q) for all series. ``beta`` starts with the
    constant of the difference equation; ``terms`` are the weights of the four polynomials in the order AR, MA,
    seasonal AR, seasonal MA. Every row of a series with a fit has a residual: rows that differencing uses up
    take the first value for those before it. ``status`` tells what a short series went without.
    """
    known = with_design(series, holidays, regressors).select(*keys, "date", F.col("total_sales").alias("value"), "xreg")
    ahead = with_design(future_dates(series, horizon, keys), holidays, regressors)
    rows = known.unionByName(ahead.select(*keys, "date", F.lit(None).cast("double").alias("value"), "xreg"))
    fits = cut_lineage(arima.fit_series(rows, keys, limits, period, select=select))
    fitted = arima.exploded(fits, keys, "rows", ("date", "value", "w", "residual"))
    coefficients = ("ar", "ma", "terms", "beta", "sigma2", "log_likelihood", "aic")
    return {
        "orders": fits.select(*keys, *ORDERS, "status", "n", "n_eff", "sigma2", "aic"),
        "coefficients": fits.select(*keys, *ORDERS, "status", "n_eff", *coefficients),
        "fitted": fitted.withColumn("residual", F.when(~F.isnan("residual"), F.col("residual"))),
        "forecast": _ahead(fits, keys).select(*keys, "model", "date", "yhat", "lower", "upper"),
    }


def train(
    series: DataFrame,
    keys: Sequence[str] = TOTAL,
    horizon: int = HORIZON,
    holidays: Holidays = MODEL_HOLIDAYS,
    regressors: bool = True,
    grid_search: bool = True,
    limits: Mapping[str, int] | None = None,
    period: int | None = SEASONAL_PERIOD,
) -> dict[str, DataFrame]:
    """Order search, exact fit, residual diagnostics and forecast for every series."""
    limits = limits or (ARIMA_RUN_GRID if grid_search else ARIMA_DEFAULT_GRID)
    out = fit_exact(series, keys, horizon, holidays, regressors, "grid" if grid_search else "exact", limits, period)
    fitted = out.pop("fitted")
    return out | {
        "residuals": fitted.select(*keys, "date", "residual"),
        "ljung_box": ljung_box(fitted, keys=keys),
        "shapiro": shapiro_wilk(fitted, keys=keys),
    }


def run(
    series: DataFrame,
    keys: Sequence[str] = TOTAL,
    horizon: int = HORIZON,
    evaluate_model: bool = True,
    cross_validation: bool = True,
    holidays: Holidays = MODEL_HOLIDAYS,
    regressors: bool = True,
    grid_search: bool = True,
) -> dict[str, DataFrame]:
    """Everything :func:`train` gives, with holdout and cross-validation tables."""
    out = train(series, keys, horizon, holidays, regressors, grid_search)
    if evaluate_model:
        out["holdout"], out["metrics"] = evaluate_holdout(
            series, keys, holidays=holidays, regressors=regressors)
    if cross_validation:
        out["cv_folds"], out["cv_average"] = cross_validate(
            series, keys, holidays=holidays, regressors=regressors)
    return out
