"""Seasonal ARIMA with regressors: one pass over each series.

A series, its future rows included, meets once in a task, bounded by its calendar days; what
leaves it are orders, coefficients, residuals and forecasts. Folds and holdouts are stretches
of the same arrays, so no row is copied for them.

1. Orders are screened by two-stage least squares: a long autoregression gives innovations,
   then one Gram matrix of the lag vector scores every candidate of a differencing. Before
   its first row a series counts as its level (the mean of its first period; 0 if
   differenced), so candidates use all rows they have and short series have candidates, too.
   Gram matrices are summed along the series: every fold reads its own from one pass.
2. The chosen order is fitted by exact likelihood (``likelihood``), seasonal and plain terms
   multiplied out, regressors and terms together.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandspark.operators.gram import key_fields, least_squares, residual_sum, spread
from demandspark.operators.grids import ORDER_COLUMNS
from demandspark.operators.likelihood import BOUND, Fit, Likelihood, Order, continued, response
from demandspark.operators.lags import (
    ar_lags,
    candidates,
    difference_weights,
    innovation_basis,
    lagged_basis,
    largest_root,
    pick_lag,
)
from demandspark.schema import KPSS_LIMIT, SEASONAL_PERIOD, STRENGTH_LIMIT

LONG_AR = 2 * SEASONAL_PERIOD
# fewer rows have no level to forecast from; from LEAST_ORDER on a series has an order of its own
LEAST_ROWS = 4
LEAST_ORDER = 8
Z95 = 1.96

# (unit number, rows to train on, rows up to which to forecast)
Units = Callable[[np.ndarray, int, int], list[tuple[int, int, int]]]


def differenced(a: np.ndarray, d: int, sd: int, m: int, backcast: bool = False) -> np.ndarray:
    """Differences along the first axis; with ``backcast`` the first row stands for those before it."""
    if backcast and d + sd * m:
        a = np.concatenate([np.repeat(a[:1], d + sd * m, axis=0), a])
    for _ in range(sd):
        a = a[m:] - a[:-m]
    for _ in range(d):
        a = a[1:] - a[:-1]
    return a


def kpss_level(x: np.ndarray) -> float:
    """Level stationarity statistic with Bartlett weights up to lag trunc(4 (n/100)^(1/4))."""
    n = len(x)
    e = x - x.mean()
    lags = int(4 * (n / 100) ** 0.25)
    s2 = e @ e + 2 * sum((1 - j / (lags + 1)) * (e[j:] @ e[:-j]) for j in range(1, min(lags, n - 1) + 1))
    total = np.cumsum(e)
    return float(total @ total / (n * s2)) if s2 > 1e-12 * max(x @ x, 1e-300) else 0.0


def seasonal_strength(y: np.ndarray, m: int) -> float:
    """1 - var(remainder) / var(seasonal + remainder) of the classical decomposition, at least 0."""
    n, half = len(y), m // 2
    total = np.concatenate([[0.0], np.cumsum(y)])
    lo, hi = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
    left = y - (total[hi] - total[lo]) / (hi - lo)
    phase = np.arange(1, n + 1) % m
    mean = np.bincount(phase, left, m) / np.maximum(np.bincount(phase, minlength=m), 1)
    seasonal = mean[phase] - mean[np.unique(phase)].mean()
    spread_ = left.var(ddof=1) if n > 1 else 0.0
    return float(max(0.0, 1.0 - (left - seasonal).var(ddof=1) / spread_)) if spread_ > 1e-12 * max(y @ y, 1e-300) else 0.0


def differencing(y: np.ndarray, limits: Mapping[str, int], m: int | None) -> tuple[int, int]:
    """(d, D): a seasonal difference where the season is strong, then differences until the level is stationary."""
    sd = int(bool(m) and limits["D"] > 0 and len(y) >= 2 * m + 1 and seasonal_strength(y, m) > STRENGTH_LIMIT)
    w, d = differenced(y, 0, sd, m or 1), 0
    while d < limits["d"] and len(w) > LEAST_ORDER and kpss_level(w) > KPSS_LIMIT:
        w, d = w[1:] - w[:-1], d + 1
    return d, sd


class Screen:
    """Two-stage scores of candidate orders at one or more lengths of a series."""

    def __init__(self, y: np.ndarray, counts: Sequence[int], limits: Mapping[str, int], m: int, long_ar: int = LONG_AR):
        self.y, self.counts, self.m, self.long_ar = y, sorted(set(counts)), m, long_ar
        self.ar, self.ma = ar_lags((limits["p"], limits["P"]), m), ar_lags((limits["q"], limits["Q"]), m)
        self.span = long_ar + max([1, *self.ar, *self.ma])
        self.place = {("w", n): i for i, n in enumerate(self.ar, 1)}
        self.place |= {("e", n): i for i, n in enumerate(self.ma, 1 + len(self.ar))}
        self.grams: dict = {}
        self.blocks: dict = {}

    def _gram(self, count: int, d: int, sd: int) -> np.ndarray:
        """Gram matrix of (1, w[t-span], ..., w[t]) over the first ``count`` rows, summed from those of shorter stretches."""
        if (d, sd) not in self.grams:
            w = differenced(self.y, d, sd, self.m)
            if d + sd == 0:
                w = w - w[: self.m].mean()
            v = np.concatenate([np.zeros(self.span), w])
            x = np.lib.stride_tricks.sliding_window_view(v, self.span + 1) if len(w) else np.zeros((0, self.span + 1))
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            total, start, out = np.zeros((self.span + 2,) * 2), 0, {}
            for c in self.counts:
                stop = max(c - d - self.m * sd, 0)
                total = total + x[start:stop].T @ x[start:stop]
                start, out[c] = max(start, stop), total
            self.grams[d, sd] = out
        return self.grams[d, sd][count]

    def score(self, count: int, order: Order) -> tuple[int, float, float]:
        """(rows used, sigma2, AIC scaled to all rows) of an order on the first ``count`` rows."""
        d, sd = order.d, order.sd
        n = max(count - d - self.m * sd, 0)
        if (count, d, sd) not in self.blocks and n > 1:
            g = self._gram(count, d, sd)
            e = innovation_basis(g, n, self.span, self.long_ar)
            basis = [np.eye(self.span + 2)[0]] + [pick_lag(self.span, x) for x in self.ar] + [lagged_basis(e, x) for x in self.ma]
            basis, now = np.column_stack(basis), self.span + 1
            self.blocks[count, d, sd] = basis.T @ g @ basis, basis.T @ g[:, now], g[now, now]
        own_ar, own_ma = ar_lags((order.p, order.sp), self.m), ar_lags((order.q, order.sq), self.m)
        block = [0] if d + sd == 0 else []
        block += [self.place["w", x] for x in own_ar] + [self.place["e", x] for x in own_ma]
        if n <= len(block) + 1:
            return n, float("inf"), float("inf")
        xtx, xty, yty = self.blocks[count, d, sd]
        part = xtx[np.ix_(block, block)]
        coef = least_squares(part, xty[block]) if block else np.zeros(0)
        sigma2 = residual_sum(coef, part, xty[block], yty) / n
        arma = coef[len(block) - len(own_ar) - len(own_ma):]
        root = max(largest_root(own_ar, arma[: len(own_ar)]), largest_root(own_ma, -arma[len(own_ar):]))
        if root >= 1.0:
            return n, float(sigma2), float("inf")
        return n, float(sigma2), float(count * np.log(max(sigma2, 1e-12)) + 2.0 * (len(block) + 1))


def stepwise(score: Callable[[Order], float], d: int, sd: int, limits: Mapping[str, int], seasonal: bool) -> tuple[Order, float]:
    """Best order by neighbour steps from four starts (Hyndman and Khandakar 2008); ties go to the one tried first."""
    tops = Order(limits["p"], d, limits["q"], limits["P"] if seasonal else 0, sd, limits["Q"] if seasonal else 0)
    cut = lambda p, q, sp, sq: Order(min(p, tops.p), d, min(q, tops.q), min(sp, tops.sp), sd, min(sq, tops.sq))
    seen: dict[Order, float] = {}

    def tried(order: Order) -> float:
        if order not in seen:
            seen[order] = score(order)
        return seen[order]

    best = min([cut(2, 2, 1, 1), cut(0, 0, 0, 0), cut(1, 0, 1, 0), cut(0, 1, 0, 1)], key=tried)
    steps = [(a, b, c, e) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) for e in (-1, 0, 1)
             if (a, b, c, e) != (0,) * 4 and (c, e) == (0, 0) or (a, b) == (0, 0) and (c, e) != (0, 0)]
    while True:
        near = [Order(best.p + a, d, best.q + b, best.sp + c, sd, best.sq + e) for a, b, c, e in steps]
        near = [x for x in near if 0 <= x.p <= tops.p and 0 <= x.q <= tops.q and 0 <= x.sp <= tops.sp and 0 <= x.sq <= tops.sq]
        better = min([best, *near], key=tried)
        if better == best:
            return best, seen[best]
        best = better


def corrected_aic(log_likelihood: float, n: int, parameters: int) -> float:
    room = n - parameters - 1
    return -2.0 * log_likelihood + 2.0 * parameters + 2.0 * parameters * (parameters + 1) / room if room > 0 else float("inf")


def fit_order(y: np.ndarray, x: np.ndarray, order: Order, m: int) -> tuple[Fit, str, int]:
    """(fit, status, columns used): regressors give way first, then the terms, where rows are too few for them."""
    d, sd = order.d, order.sd
    w, dx = differenced(y, d, sd, m), differenced(x, d, sd, m)
    constant = np.ones((len(w), 1 if d + sd == 0 else 0))
    status = "fitted"
    if len(w) <= order.terms + constant.shape[1] + x.shape[1] + 1:
        dx, status = dx[:, :0], "fitted" if not x.shape[1] else "without regressors"
    if len(w) <= order.terms + constant.shape[1] + 1:
        order, status = Order(d=d, sd=sd), "level"
    return Likelihood(order, w, np.concatenate([constant, dx], axis=1), m).maximise(), status, dx.shape[1]


def exact_search(y: np.ndarray, x: np.ndarray, limits: Mapping[str, int], m: int | None) -> tuple[Order, float]:
    """Differencing by tests, then neighbour steps by corrected AIC of the exact likelihood.

    Orders are compared on what regressors leave by least squares.
    """
    d, sd = differencing(y, limits, m)
    w, dx = differenced(y, d, sd, m or 1), differenced(x, d, sd, m or 1)
    columns = np.concatenate([np.ones((len(w), 1 if d + sd == 0 else 0)), dx], axis=1)
    if len(w) <= columns.shape[1] + 4:
        columns = columns[:, : columns.shape[1] - dx.shape[1]]
    left = w - columns @ least_squares(columns.T @ columns, columns.T @ w) if columns.shape[1] else w
    own = np.ones((len(w), 1 if d + sd == 0 else 0))

    def score(order: Order) -> float:
        if len(w) <= order.terms + own.shape[1] + 1:
            return float("inf")
        found = Likelihood(order, left, own, m or 1).maximise(15)
        return corrected_aic(found.log_likelihood, len(w), order.terms + own.shape[1] + 1)

    return stepwise(score, d, sd, limits, bool(m))


def whole_and_future(dates, known, rows):
    return [(0, known, rows)]


def holdout_unit(days: int) -> Units:
    """Trains before (last date - days), forecasts the rows from it on."""
    def units(dates, known, rows):
        cut = int(np.searchsorted(dates, dates[known - 1] - np.timedelta64(days, "D")))
        return [(0, cut, known)]

    return units


def expanding_units(k: int) -> Units:
    """Folds as in ``panel.expanding_folds``; one without training rows is left out."""
    def units(dates, known, rows):
        size = known // k
        out = [(i, known - (k - i + 1) * size, min(known - (k - i) * size, known)) for i in range(1, k + 1)]
        return [u for u in out if size > 0 and u[1] > 0]

    return units


ARRAYS = {
    "grid": ("grid_id", "grid_n", "grid_sigma2", "grid_aic"),
    "ahead": ("ahead_date", "ahead_actual", "yhat", "lower", "upper"),
    "rows": ("row_date", "row_value", "row_w", "row_residual"),
}
ORDERS = list(ORDER_COLUMNS.values())


def fit_series(
    rows: DataFrame, keys: Sequence[str], limits: Mapping[str, int], period: int | None = SEASONAL_PERIOD,
    units: Units = whole_and_future, select: str | Sequence[int] = "grid", keep: Sequence[str] = ("ahead", "rows"), fit: bool = True,
) -> DataFrame:
    """One row per series and unit with its order, coefficients and the arrays asked for by ``keep``.

    ``rows`` are (keys, date, value, xreg); rows without a value after the last known one are
    forecast, others are left out. ``select`` is an order for all series, or ``grid`` (all candidates, screened), ``auto``
    (differencing by tests, neighbour steps, screened) or ``exact`` (the same by exact
    likelihood). ``status``: ``fitted``, ``without regressors`` or ``level`` where rows are too
    few for them, and ``too short`` (under LEAST_ROWS rows, no fit or forecast). From
    LEAST_ORDER rows on a series has an order of its own. Two rows of a series on one date
    are an error. With ``fit`` off only orders are chosen.
    """
    names, m = list(keys), period or 1
    grid = candidates(limits, period)

    def chosen(screen: Screen, y, x, count: int, scored: list[tuple]) -> tuple[Order, float]:
        """An order and its score on the first ``count`` rows; that of a level where none can be scored."""
        if not isinstance(select, str):
            return Order(*select), 0.0
        if count < LEAST_ORDER:
            return Order(), float("inf")
        if select == "exact":
            order, score = exact_search(y[:count], x[:count], limits, period)
        elif select == "auto":
            d, sd = differencing(y[:count], limits, period)
            order, score = stepwise(lambda o: screen.score(count, o)[2], d, sd, limits, bool(period))
        else:
            best = min(range(len(scored)), key=lambda i: scored[i][3])
            order, score = Order(*grid[best][1:]), scored[best][3]
        return (order, score) if np.isfinite(score) else (Order(), score)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        dates = pdf["date"].to_numpy().astype("datetime64[D]")
        if len(dates) > 1 and not (dates[1:] > dates[:-1]).all():
            raise ValueError("series key and date do not identify a row: remove or sum copies first")
        y = pdf["value"].to_numpy(dtype=float)
        there = np.flatnonzero(np.isfinite(y))
        if not len(there):
            return pd.DataFrame(columns=[f.name for f in schema])
        keep_rows = np.isfinite(y) | (np.arange(len(y)) > there[-1])
        pdf, dates, y = pdf[keep_rows], dates[keep_rows], y[keep_rows]
        known = len(there)
        x = np.stack(pdf["xreg"].to_numpy()).astype(float) if len(pdf["xreg"].iloc[0]) else np.zeros((len(y), 0))
        stretches = units(dates, known, len(y))
        screen = Screen(y[:known], [c for _, c, _ in stretches], limits, m)
        out = []
        for number, count, stop in stretches:
            row = dict.fromkeys([f.name for f in schema])
            row |= dict(zip(names, key, strict=True)) | {"unit": number, "n": count, "n_ahead": stop - count, "status": "too short"}
            scored = [(i, *screen.score(count, Order(*o))) for i, *o in grid] if "grid" in (select, *keep) else []
            if "grid" in keep:
                row |= dict(zip(ARRAYS["grid"], map(list, zip(*scored, strict=True)), strict=True))
            if count >= LEAST_ROWS:
                order, score = chosen(screen, y, x, count, scored)
                row |= dict(zip(ORDERS, order, strict=True)) | {"score": score, "n_eff": count - order.d - m * order.sd}
                row["status"] = "fitted"
                if fit:
                    row |= described(y, x, dates, order, count, stop)
                if not np.isfinite(score):
                    row["status"] = "level"
            elif "rows" in keep:
                row |= {"row_date": list(dates[:count].astype(object)), "row_value": y[:count], "row_w": y[:count], "row_residual": np.full(count, np.nan)}
            out.append(row)
        return pd.DataFrame(out, columns=[f.name for f in schema])

    def described(y, x, dates, order, count, stop) -> dict:
        found, status, columns = fit_order(y[:count], x[:count], order, m)
        order = found.order
        own_x = x[:, :columns]
        constant = 1 if order.d + order.sd == 0 else 0
        slope = found.beta[constant:]
        mean = found.beta[0] if constant else 0.0
        w = differenced(y[:count], order.d, order.sd, m, backcast=True)
        noise = w - mean - differenced(own_x[:count], order.d, order.sd, m, backcast=True) @ slope
        lost = order.d + m * order.sd
        row = dict(zip(ORDERS, order, strict=True)) | {
            "status": status, "n_eff": count - lost, "ar": found.ar, "ma": found.ma, "terms": terms_of(found),
            # the constant of the difference equation, then the regressors
            "beta": np.concatenate([[mean * (1.0 - found.ar.sum())], slope]), "sigma2": found.sigma2,
            "log_likelihood": found.log_likelihood,
            "aic": 2.0 * (order.terms + len(found.beta) + 1) - 2.0 * found.log_likelihood,
        }
        if "rows" in keep:
            residual = np.concatenate([noise[:lost], found.residual])
            row |= dict(zip(ARRAYS["rows"], (list(dates[:count].astype(object)), y[:count], w, residual), strict=True))
        if "ahead" in keep and stop > count:
            h = stop - count
            ahead = continued(found, noise[lost:], h) + mean + differenced(own_x[:stop], order.d, order.sd, m)[count - lost:] @ slope
            back = difference_weights(order.d, order.sd, m)
            values = np.concatenate([y[:count], np.zeros(h)])
            for i in range(h):
                values[count + i] = ahead[i] - sum(c * values[count + i - lag] for lag, c in back.items() if lag)
            poly = np.zeros(max(back) + 1)
            poly[list(back)] = list(back.values())
            whole = np.convolve(np.concatenate([[1.0], -found.ar]), poly)
            half = Z95 * np.sqrt(found.sigma2 * np.cumsum(response(-whole[1:], found.ma, h) ** 2))
            yhat = values[count:]
            row |= dict(zip(ARRAYS["ahead"], (list(dates[count:stop].astype(object)), y[count:stop], yhat, yhat - half, yhat + half), strict=True))
        return row

    def terms_of(found: Fit) -> np.ndarray:
        """phi, theta, Phi, Theta as they stand in the four polynomials."""
        o = found.order
        seasonal_ar, seasonal_ma = found.ar[m - 1:: m][: o.sp] if period else [], found.ma[m - 1:: m][: o.sq] if period else []
        return np.concatenate([found.ar[: o.p], found.ma[: o.q], seasonal_ar, seasonal_ma])

    double, kinds = T.ArrayType(T.DoubleType()), {"grid_id": T.IntegerType(), "grid_n": T.LongType(), "ahead_date": T.DateType(), "row_date": T.DateType()}
    schema = T.StructType([
        *key_fields(rows, keys), T.StructField("unit", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("n_ahead", T.LongType()), T.StructField("status", T.StringType()),
        *[T.StructField(c, T.IntegerType()) for c in ORDERS], T.StructField("score", T.DoubleType()), T.StructField("n_eff", T.LongType()),
        *[T.StructField(c, double) for c in ("ar", "ma", "terms", "beta")],
        *[T.StructField(c, T.DoubleType()) for c in ("sigma2", "log_likelihood", "aic")],
        *[T.StructField(c, T.ArrayType(kinds.get(c, T.DoubleType()))) for part in keep for c in ARRAYS[part]],
    ])
    given = spread(rows.select(*keys, "date", F.col("value").cast("double").alias("value"), "xreg"), keys)
    return given.groupBy(*keys).applyInPandas(one, schema)


def likelihood_profile(
    rows: DataFrame, keys: Sequence[str], order: Sequence[int], trials: Sequence[Sequence[float]], period: int = SEASONAL_PERIOD,
) -> DataFrame:
    """(keys, trial, terms, log_likelihood, sigma2) of every series at given weights of its terms.

    ``rows`` are (keys, date, value); the level (undifferenced) and the variance are the likeliest given the terms. The order has at
    most one term in each polynomial, ``trials`` give them as AR, MA, seasonal AR, seasonal MA.
    """
    order = Order(*order)
    if max(order.p, order.q, order.sp, order.sq) > 1:
        raise ValueError("at most one term in each polynomial")
    sign = [1.0] * order.p + [-1.0] * order.q + [1.0] * order.sp + [-1.0] * order.sq
    free = np.array([[np.arctanh(s * t / BOUND) for s, t in zip(sign, trial, strict=True)] for trial in trials])
    names = list(keys)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w = differenced(pdf.sort_values("date")["value"].to_numpy(dtype=float), order.d, order.sd, period)
        if not len(w):
            return pd.DataFrame(columns=[*names, "trial", "terms", "log_likelihood", "sigma2"])
        model = Likelihood(order, w, np.ones((len(w), 1 if order.d + order.sd == 0 else 0)), period)
        out = [(*key, i, list(trial), float(model.value(u[None])[0]), model.at(u).sigma2) for i, (trial, u) in enumerate(zip(trials, free, strict=True))]
        return pd.DataFrame(out, columns=[*names, "trial", "terms", "log_likelihood", "sigma2"])

    schema = T.StructType([
        *key_fields(rows, keys), T.StructField("trial", T.IntegerType()), T.StructField("terms", T.ArrayType(T.DoubleType())),
        T.StructField("log_likelihood", T.DoubleType()), T.StructField("sigma2", T.DoubleType())])
    return spread(rows.select(*keys, "date", F.col("value").cast("double").alias("value")), keys).groupBy(*keys).applyInPandas(one, schema)


def exploded(fits: DataFrame, keys: Sequence[str], part: str, names: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """The arrays of one ``part`` as rows (keys, extra, names)."""
    zipped = F.explode(F.arrays_zip(*ARRAYS[part])).alias("_z")
    return fits.select(*keys, *extra, zipped).select(
        *keys, *extra, *[F.col(f"_z.{a}").alias(b) for a, b in zip(ARRAYS[part], names, strict=True)])
