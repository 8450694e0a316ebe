"""Trend + seasonality + holiday + regressor model for many series.

Taylor and Letham (2018) as penalised least squares: a piecewise-linear trend
with changepoints spread evenly over the first 80% of history, weekly and
monthly Fourier terms, holiday-window dummies and standardised regressors.
Prior scales become ridge penalties sigma^2/scale^2; changepoints have a Laplace prior
or, in searches, a Gaussian one of the same variance 2*scale^2. Daily seasonality is constant on daily
data and has no column. Multiplicative models fit the trend first, then the
ratio to it. Point estimates differ from a full posterior fit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandspark.functions.calendar import Holidays, fourier_pair, with_holiday_flags
from demandspark.functions.metrics import evaluate
from demandspark.functions.stats import normal_quantile
from demandspark.operators.gram import (
    attach,
    dot,
    key_fields,
    least_squares,
    residual_sum,
    spread,
)
from demandspark.operators.grids import best_candidate
from demandspark.operators.panel import future_dates, holdout_split
from demandspark.operators.regressors import with_exogenous
from demandspark.schema import (
    HOLDOUT_DAYS,
    HORIZON,
    MODEL_HOLIDAYS,
    SPECIAL_EVENTS,
    STRUCTURAL_DEFAULTS,
    STRUCTURAL_GRID,
    STRUCTURAL_REGRESSORS,
    TOTAL,
)
from demandspark.session import cut_lineage

CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
WEEKLY = (7, 3)
MONTHLY = (30.5, 5)
Z80 = 1.2816
SAMPLES = 400
BASE_SCALE = 5.0
UNSEEN = 1e8
# tried noise variances as parts of the mean square
NOISE_STEPS = 10.0 ** np.linspace(-8.0, 0.0, 81)
MODEL = "prophet"

KNOTS = [CHANGEPOINT_RANGE * j / CHANGEPOINTS for j in range(1, CHANGEPOINTS + 1)]
N_TREND = 2 + CHANGEPOINTS
N_WEEKLY, N_MONTHLY, N_HOLIDAY = 2 * WEEKLY[1], 2 * MONTHLY[1], 3
GROUPS = {
    "weekly": (0, N_WEEKLY),
    "monthly": (N_WEEKLY, N_MONTHLY),
    "holidays": (N_WEEKLY + N_MONTHLY, N_HOLIDAY),
}
FIRST_REGRESSOR = N_WEEKLY + N_MONTHLY + N_HOLIDAY
PARAMETERS = list(STRUCTURAL_DEFAULTS)
DOUBLES = T.ArrayType(T.DoubleType())


def with_effects(
    series: DataFrame,
    holidays: Holidays = MODEL_HOLIDAYS,
    exogenous: DataFrame | None = None,
    events: Holidays = SPECIAL_EVENTS,
) -> DataFrame:
    """Adds ``effects``: seasonal, holiday and (with a table) regressor columns per row."""
    d = F.col("date")
    columns = [
        term for period, order in (WEEKLY, MONTHLY)
        for k in range(1, order + 1) for term in fourier_pair(d, period, k)
    ]
    df = with_holiday_flags(series, holidays)
    columns += [F.col(f"is_{x}holiday") for x in ("day_before_", "", "day_after_")]
    if exogenous is not None:
        df = with_exogenous(df, exogenous, events)
        columns += [F.col(c).cast("double") for c in STRUCTURAL_REGRESSORS]
    df = df.withColumn("effects", F.array(*columns))
    return df.select(*series.columns, "effects")


def _with_trend(df: DataFrame) -> DataFrame:
    """x = [1, t, hinges..., effects...] with t = 0 at the first and 1 at the last training day."""
    span = F.greatest(F.datediff("last", "first"), F.lit(1))
    t = F.datediff("date", "first") / span
    hinges = [F.greatest(F.col("_t") - k, F.lit(0.0)) for k in KNOTS]
    trend = F.array(F.lit(1.0), F.col("_t"), *hinges)
    return df.withColumn("_t", t).withColumn("x", F.concat(trend, "effects")).drop("_t", "effects")


def _penalties(n_effects: int, parameters: Mapping[str, float], days: int) -> np.ndarray:
    """1/variance per column; multiply by the noise variance for the ridge.

    A season of which no whole period lies in the ``days`` of history is left out:
    it could not be told from the trend.
    """
    seasonal = N_WEEKLY + N_MONTHLY
    unseen = [UNSEEN if days < p else 1.0 for p, order in (WEEKLY, MONTHLY) for _ in range(2 * order)]
    return np.concatenate(
        [
            np.full(2, BASE_SCALE**-2),
            np.full(CHANGEPOINTS, 0.5 * parameters["changepoint_prior_scale"] ** -2),
            np.array(unseen) * parameters["seasonality_prior_scale"] ** -2,
            np.full(n_effects - seasonal, parameters["holidays_prior_scale"] ** -2),
        ]
    )


def _standardising(g: np.ndarray, n: int) -> np.ndarray:
    """Column transform that centres and scales the regressors, read off the Gram itself."""
    move = np.eye(len(g))
    for j in range(N_TREND + FIRST_REGRESSOR, len(g)):
        mean = g[0, j] / n
        variance = max(g[j, j] / n - mean**2, 0.0)
        # a regressor without variation has no effect
        scale = 1.0 / np.sqrt(variance) if variance > 1e-12 * max(mean**2, 1.0) else 0.0
        move[j, j] = scale
        move[0, j] = -mean * scale
    return move


def _noise(g: np.ndarray, xty: np.ndarray, yty: float, n: int, penalty: np.ndarray) -> float:
    """The noise variance under which the data are likeliest, given the priors.

    Coefficients are integrated out, so a series with no more rows than columns keeps its
    noise and the priors keep acting; a fit that interpolates is not taken for a good one.
    """
    root = 1.0 / np.sqrt(penalty)
    size, axes = np.linalg.eigh(root[:, None] * g * root)
    size, seen = np.maximum(size, 0.0), (axes.T @ (root * xty)) ** 2
    noise = np.maximum(yty / n, 1e-12) * NOISE_STEPS
    total = size[None] + noise[:, None]
    rest = np.maximum(yty - (seen[None] / total).sum(1), 0.0)
    cost = np.log(total / noise[:, None]).sum(1) + n * np.log(noise) + rest / noise
    return max(float(noise[np.argmin(cost)]), 1e-8)


def _noise_penalties(n_effects: int, parameters: Mapping[str, float], days: int) -> np.ndarray:
    """What the noise is estimated under: the changepoint prior asked for, the default ones for the rest.

    Candidates that differ in the other priors then share a noise variance, and its cost.
    """
    usual = {c: STRUCTURAL_DEFAULTS[c] for c in ("seasonality_prior_scale", "holidays_prior_scale")}
    return _penalties(n_effects, {**parameters, **usual}, days)


def _trend_design(t: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones_like(t), t, *[np.maximum(t - k, 0.0) for k in KNOTS]])


def lasso(g: np.ndarray, b: np.ndarray, weight: float) -> np.ndarray:
    """The x that minimises x'gx / 2 - b'x + weight * sum |x|, exactly, by feature-sign steps.

    Signs of the active coordinates are guessed, the system under them is solved, and the way there
    stops at the best sign change; then the coordinate with the steepest slope joins. Every step
    lowers the objective, so no set of signs comes twice.
    """
    x, sign = np.zeros(len(b)), np.zeros(len(b))
    cost = lambda v: 0.5 * v @ g @ v - b @ v + weight * np.abs(v).sum()
    tiny = 1e-12 * max(weight, np.abs(b).max(initial=0.0), 1e-300)
    for _ in range(60 * len(b) + 60):
        slope = g @ x - b
        free = sign == 0
        excess = np.where(free, np.abs(slope) - weight, 0.0)
        active = np.flatnonzero(~free)
        settled = not len(active) or np.abs(slope[active] + weight * sign[active]).max() <= 1e3 * tiny
        if settled:
            if excess.max(initial=0.0) <= 1e3 * tiny:
                break
            join = int(np.argmax(excess))
            sign[join] = -np.sign(slope[join])
            active = np.append(active, join)
        want = np.zeros(len(b))
        want[active] = np.linalg.lstsq(g[np.ix_(active, active)], b[active] - weight * sign[active], rcond=None)[0]
        way = want - x
        crossing = [x[i] / (x[i] - want[i]) for i in active if x[i] * want[i] < 0]
        trials = [x + r * way for r in sorted({1.0, *crossing})]
        best = min(trials, key=cost)
        # what the way crosses at the chosen point leaves
        for i in active:
            if abs(best[i]) <= 1e-14 * max(abs(x[i]), abs(want[i]), 1e-300):
                best[i] = 0.0
        if not cost(best) < cost(x):
            sign = np.sign(x)
            if settled:
                break
            continue
        x, sign = best, np.sign(best)
    return x


def _coefficients(g: np.ndarray, xty: np.ndarray, ridge: np.ndarray, weight: float | None) -> np.ndarray:
    """Penalised least squares; with ``weight`` the changepoints have a Laplace prior in place of the ridge.

    All other coefficients are eliminated first: given the changepoints they follow from a linear system.
    """
    if weight is None:
        return least_squares(g, xty, ridge)
    points = np.arange(2, N_TREND)
    rest = np.setdiff1d(np.arange(len(g)), points)
    own = g[np.ix_(rest, rest)] + np.diag(ridge[rest])
    across = np.linalg.solve(own, np.column_stack([g[np.ix_(rest, points)], xty[rest]]))
    reduced = g[np.ix_(points, points)] - g[np.ix_(points, rest)] @ across[:, :-1]
    delta = lasso(reduced, xty[points] - g[np.ix_(points, rest)] @ across[:, -1], weight)
    out = np.zeros(len(g))
    out[points], out[rest] = delta, across[:, -1] - across[:, :-1] @ delta
    return out


def optimality(g: np.ndarray, xty: np.ndarray, ridge: np.ndarray, weight: float, coef: np.ndarray) -> float:
    """Largest breach of the optimality conditions of the Laplace fit, relative to ``weight``."""
    slope = g @ coef - xty
    points = np.arange(2, N_TREND)
    smooth = np.delete(slope + ridge * coef, points)
    at, delta = slope[points], coef[points]
    inner = np.where(delta != 0, np.abs(at + weight * np.sign(delta)), np.maximum(np.abs(at) - weight, 0.0))
    return float(max(inner.max(), np.abs(smooth).max()) / weight)


def fit(
    train: DataFrame,
    parameters: DataFrame | Mapping[str, float | str] = STRUCTURAL_DEFAULTS,
    keys: Sequence[str] = TOTAL,
    value: str = "total_sales",
    prior: str = "gaussian",
) -> DataFrame:
    """One row per series: first, last, y_scale, parameters, trend, effect, sigma, breach.

    ``train`` is (keys, date, value, effects). ``trend`` and ``effect`` are
    weights on the same design row; ``parameters`` may differ per series. ``prior`` of the
    changepoints: ``laplace`` leaves most of them at 0, ``gaussian`` has the same variance; ``breach`` tells
    how far the Laplace fit is from its optimality conditions (NULL for the other). Each series
    meets once in a task, trend and effects are fitted there.
    """
    if prior not in ("gaussian", "laplace"):
        raise ValueError(prior)
    names = list(keys)
    rows = train.select(*names, "date", F.col(value).cast("double").alias("_value"), "effects")
    if isinstance(parameters, DataFrame):
        rows = attach(rows, parameters.select(*names, *PARAMETERS), keys)
    else:
        rows = rows.withColumns({p: F.lit(parameters[p]) for p in PARAMETERS})
    columns = [*names, "first", "last", "y_scale", *PARAMETERS, "trend", "effect", "sigma", "breach"]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        chosen = {p: pdf[p].iloc[0] for p in PARAMETERS}
        first, last = pdf["date"].iloc[0], pdf["date"].iloc[-1]
        pdf = pdf[pdf["_value"].notna()]
        if pdf.empty:
            return pd.DataFrame(columns=columns)
        y, effects = pdf["_value"].to_numpy(dtype=float), np.stack(pdf["effects"].to_numpy()).astype(float)
        day = pdf["date"].to_numpy().astype("datetime64[D]").astype(np.int64)
        scale = float(np.abs(y).max()) or 1.0
        found = _fitted(day, y / scale, effects, first, last, chosen, prior)
        return pd.DataFrame([(*key, first, last, scale, *chosen.values(), *found)], columns=columns)

    kinds = {p: T.StringType() if p == "seasonality_mode" else T.DoubleType() for p in PARAMETERS}
    schema = T.StructType([
        *key_fields(train, keys), T.StructField("first", T.DateType()), T.StructField("last", T.DateType()), T.StructField("y_scale", T.DoubleType()),
        *[T.StructField(p, kinds[p]) for p in PARAMETERS], T.StructField("trend", DOUBLES), T.StructField("effect", DOUBLES),
        T.StructField("sigma", T.DoubleType()), T.StructField("breach", T.DoubleType())])
    return cut_lineage(spread(rows, keys).groupBy(*names).applyInPandas(one, schema))


def _fitted(day, y, effects, first, last, parameters: Mapping, prior: str) -> tuple[np.ndarray, np.ndarray, float, float | None]:
    """(trend, effect, sigma, breach) of one series."""
    days = (last - first).days
    start = np.datetime64(first, "D").astype(np.int64)
    x = np.hstack([_trend_design((day - start) / max(days, 1)), effects])
    n, yty = len(y), float(y @ y)
    g = x.T @ x
    move = _standardising(g, n)
    x = x @ move
    g, xty = x.T @ x, x.T @ y
    multiplicative = parameters["seasonality_mode"] == "multiplicative"
    size = N_TREND if multiplicative else len(g)
    own, target = g[:size, :size], xty[:size]
    noise = _noise(own, target, yty, n, _noise_penalties(effects.shape[1], parameters, days + 1)[:size])
    ridge = noise * _penalties(effects.shape[1], parameters, days + 1)[:size]
    weight = noise / parameters["changepoint_prior_scale"] if prior == "laplace" else None
    coef = np.zeros(len(g))
    coef[:size] = _coefficients(own, target, ridge, weight)
    breach = optimality(own, target, ridge, weight, coef[:size]) if weight else None
    sigma = np.sqrt(residual_sum(coef[:size], own, target, yty) / n)
    trend, effect = coef.copy(), coef.copy()
    trend[N_TREND:], effect[:N_TREND] = 0.0, 0.0
    if multiplicative:
        # effects on value / trend - 1; the trend columns only serve the centring
        level = x @ trend
        ratio = y / np.where(np.abs(level) > 1e-6, level, 1e-6) - 1.0
        rest = slice(N_TREND, None)
        own, target, yty = g[rest, rest], x[:, rest].T @ ratio, float(ratio @ ratio)
        noise = _noise(own, target, yty, n, _noise_penalties(effects.shape[1], parameters, days + 1)[rest])
        effect[rest] = least_squares(own, target, noise * _penalties(effects.shape[1], parameters, days + 1)[rest])
        sigma = np.sqrt(residual_sum(effect[rest], own, target, yty) / n)
    return trend, move @ effect, float(sigma), breach


def predict(coefficients: DataFrame, rows: DataFrame, keys: Sequence[str] = TOTAL) -> DataFrame:
    """(keys, model, date, yhat, lower, upper, trend, weekly, monthly, holidays, regressors).

    ``rows`` is (keys, date, effects). Components of a multiplicative model are
    ratios to the trend; of an additive one, amounts.
    """
    placed = _with_trend(attach(rows.select(*keys, "date", "effects"), coefficients, keys))
    multiplicative = F.col("seasonality_mode") == "multiplicative"

    def part(start: int, length: int) -> Column:
        return dot(F.slice("effect", N_TREND + 1 + start, length), F.slice("x", N_TREND + 1 + start, length))

    unit = F.when(multiplicative, 1.0).otherwise(F.col("y_scale"))
    components = {name: part(*where) * unit for name, where in GROUPS.items()}
    # the first weight of ``effect`` undoes the centring of the regressors
    rest = F.size("x") - (N_TREND + FIRST_REGRESSOR)
    after = N_TREND + FIRST_REGRESSOR + 1
    outside = dot(F.slice("effect", F.lit(after), rest), F.slice("x", F.lit(after), rest))
    components["regressors"] = (outside + F.col("effect")[0]) * unit
    scaled = placed.withColumns({**components, "trend": dot(F.col("trend"), F.col("x")) * F.col("y_scale")})
    total = sum((F.col(c) for c in components), F.lit(0.0))
    yhat = F.when(multiplicative, F.col("trend") * (1.0 + total)).otherwise(F.col("trend") + total)
    half = Z80 * F.col("sigma") * F.when(multiplicative, F.abs("trend")).otherwise(F.col("y_scale"))
    return scaled.withColumn("yhat", yhat).select(
        *keys,
        F.lit(MODEL).alias("model"),
        "date",
        "yhat",
        (F.col("yhat") - half).alias("lower"),
        (F.col("yhat") + half).alias("upper"),
        "trend",
        *components,
    )


def with_simulated_interval(
    forecast: DataFrame, coefficients: DataFrame, keys: Sequence[str] = TOTAL, samples: int = SAMPLES, seed: int = 1, level: float = 0.8,
) -> DataFrame:
    """``forecast`` with ``lower`` and ``upper`` from simulated futures (Taylor and Letham 2018).

    Every future day is a changepoint with the frequency of those of the history; its size is Laplace
    with the mean absolute size of the fitted ones. A sample's path adds the noise of the fit. Draws are
    hashes of series, sample and day, so reruns agree; bounds are the quantiles of ``samples`` paths.
    """
    draw = lambda *parts: (F.xxhash64(*[F.lit(p) if isinstance(p, str) else p for p in parts]).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    inside = lambda u: F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), u))
    span = F.greatest(F.datediff("last", "first"), F.lit(1))
    deltas = F.slice("trend", 3, CHANGEPOINTS)
    size = F.aggregate(deltas, F.lit(0.0), lambda a, x: a + F.abs(x)) / CHANGEPOINTS
    state = coefficients.select(
        *keys, "first", "last", "y_scale", "sigma", "seasonality_mode", (size * F.col("y_scale") / span).alias("_size"),
        (CHANGEPOINTS / (CHANGEPOINT_RANGE * span)).alias("_rate"))
    days = forecast.groupBy(*keys).agg(F.max("date").alias("_end"))
    paths = attach(state, days, keys).select("*", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("_sample"))
    own = [F.lit(seed), *[F.col(k) for k in keys], F.col("_sample")]

    def change(i):
        u = draw("size", *own, i) - 0.5
        laplace = -F.col("_size") * F.signum(u) * F.log1p(-2.0 * F.abs(u) + 1e-12)
        return F.when(draw("change", *own, i) < F.col("_rate"), laplace).otherwise(0.0)

    # slope and level of a path so far, day after day
    ahead = F.sequence(F.lit(1), F.greatest(F.datediff("_end", "last"), F.lit(1)))
    changes = F.transform(ahead, change)
    none = F.array().cast("array<double>")
    start = F.struct(F.lit(0.0).alias("slope"), F.lit(0.0).alias("at"), none.alias("path"))

    def step(s, c):
        at = s["at"] + s["slope"]
        return F.struct((s["slope"] + c).alias("slope"), at.alias("at"), F.concat(s["path"], F.array(at)).alias("path"))

    walked = paths.withColumn("_path", F.aggregate(changes, start, step, lambda s: s["path"]))
    each = walked.select(*keys, "last", "sigma", "y_scale", "seasonality_mode", "_sample", F.posexplode("_path").alias("_i", "_off"))
    each = each.withColumn("date", F.expr("date_add(last, _i + 1)")).withColumn("_z", normal_quantile(inside(draw("noise", *own, F.col("_i")))))
    found = each.join(forecast.select(*keys, "date", "yhat", "trend"), [*keys, "date"])
    ratio = F.col("seasonality_mode") == "multiplicative"
    moved = F.when(ratio & (F.abs("trend") > 1e-9), F.col("yhat") / F.col("trend")).otherwise(1.0)
    noise = F.col("sigma") * F.col("_z") * F.when(ratio, F.abs("trend")).otherwise(F.col("y_scale"))
    value = F.col("_off") * moved + noise
    tail = (1.0 - level) / 2.0
    bounds = found.groupBy(*keys, "date").agg(F.percentile(value, F.array(F.lit(tail), F.lit(1.0 - tail))).alias("_q"))
    joined = forecast.drop("lower", "upper").join(bounds, [*keys, "date"])
    return joined.withColumns({"lower": F.col("yhat") + F.col("_q")[0], "upper": F.col("yhat") + F.col("_q")[1]}).select(*forecast.columns)


def changepoints(coefficients: DataFrame, keys: Sequence[str] = TOTAL) -> DataFrame:
    """(keys, changepoint, date, delta): slope change per day at each changepoint."""
    span = F.greatest(F.datediff("last", "first"), F.lit(1))
    deltas = F.slice("trend", 3, CHANGEPOINTS)
    return coefficients.select(
        *keys, "first", span.alias("_span"), "y_scale", F.posexplode(deltas).alias("_j", "_delta")
    ).select(
        *keys,
        (F.col("_j") + 1).alias("changepoint"),
        F.expr(
            f"date_add(first, CAST(round(_span * {CHANGEPOINT_RANGE} * (_j + 1) / {CHANGEPOINTS}) AS INT))"
        ).alias("date"),
        (F.col("_delta") * F.col("y_scale") / F.col("_span")).alias("delta"),
    )


def _ridge_path(g: np.ndarray, xty: np.ndarray, ridges: np.ndarray) -> np.ndarray:
    """Solutions for many penalty vectors at once: (penalties, columns)."""
    systems = np.repeat(g[None], len(ridges), axis=0)
    diagonal = np.arange(len(xty))
    systems[:, diagonal, diagonal] += ridges
    return np.linalg.solve(systems, np.broadcast_to(xty[:, None], (len(ridges), len(xty), 1)))[..., 0]


class RunningGram:
    """Gram matrices of (trend, effects) over ever longer beginnings of one series, from running sums.

    The knots move with the end of the history. Sums over (d - s)+ follow from sums of z and d z up to
    the knot and the end, so no history is read again for another end.
    """

    def __init__(self, day: np.ndarray, y: np.ndarray, effects: np.ndarray):
        self.d, self.y, self.effects = (day - day[0]).astype(float), y, effects
        z = np.column_stack([np.ones(len(day)), self.d, effects, y])
        self.z = z
        start = np.zeros((1, z.shape[1]))
        self.sums = np.concatenate([start, np.cumsum(z, axis=0)])
        self.by_day = np.concatenate([start, np.cumsum(self.d[:, None] * z, axis=0)])
        self.done, self.own = 0, np.zeros((z.shape[1], z.shape[1]))
        self.known: dict = {}

    def penalties(self, grid: Sequence[Mapping], days: int) -> tuple[np.ndarray, np.ndarray]:
        """Penalties of every candidate, and those its noise is estimated under; they change only as seasons get whole."""
        key = tuple(days < p for p, _ in (WEEKLY, MONTHLY))
        if key not in self.known:
            m = self.effects.shape[1]
            self.known[key] = tuple(np.array([f(m, c, days) for c in grid]) for f in (_penalties, _noise_penalties))
        return self.known[key]

    def alike(self, grid: Sequence[Mapping]) -> list[tuple[tuple, list[int]]]:
        """Candidates by mode and changepoint scale."""
        if "alike" not in self.known:
            groups: dict[tuple, list[int]] = {}
            for i, c in enumerate(grid):
                groups.setdefault((c["seasonality_mode"], c["changepoint_prior_scale"]), []).append(i)
            self.known["alike"] = list(groups.items())
        return self.known["alike"]

    def upto(self, count: int) -> tuple[np.ndarray, np.ndarray, float]:
        """(XtX, Xty, yty) of the first ``count`` rows; ends may only grow."""
        if count < self.done:
            raise ValueError("ends must not shrink")
        part = self.z[self.done: count]
        self.done, self.own = count, self.own + part.T @ part
        span = max(self.d[count - 1], 1.0)
        knots = span * np.array(KNOTS)
        after = np.minimum(np.searchsorted(self.d, knots, side="right"), count)
        s0, s1 = self.sums[count] - self.sums[after], self.by_day[count] - self.by_day[after]
        hinge = (s1 - knots[:, None] * s0) / span
        # of two hinges the later one decides where both are positive
        later = np.maximum.outer(np.arange(CHANGEPOINTS), np.arange(CHANGEPOINTS))
        both = (s1[:, 1][later] - np.add.outer(knots, knots) * s1[:, 0][later] + np.outer(knots, knots) * s0[:, 0][later]) / span**2
        m = self.effects.shape[1]
        base = self.own.copy()
        base[1] /= span
        base[:, 1] /= span
        hinge[:, 1] /= span
        order = [0, 1, *range(2, 2 + m)]
        g = np.empty((N_TREND + m, N_TREND + m))
        plain = [0, 1, *range(N_TREND, N_TREND + m)]
        g[np.ix_(plain, plain)] = base[np.ix_(order, order)]
        g[2:N_TREND, 2:N_TREND] = both
        g[2:N_TREND, plain] = hinge[:, order]
        g[np.ix_(plain, range(2, N_TREND))] = hinge[:, order].T
        xty = np.empty(N_TREND + m)
        xty[plain], xty[2:N_TREND] = base[order, -1], hinge[:, -1]
        return g, xty, float(base[-1, -1])


def _fold_forecasts(
    running: RunningGram, day: np.ndarray, cutoff: int, horizon: int, grid: Sequence[Mapping],
) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers tested, predictions per candidate) for one cutoff of one series."""
    y, effects = running.y, running.effects
    n = int(np.searchsorted(day, cutoff, side="right"))
    test = np.arange(n, int(np.searchsorted(day, cutoff + horizon, side="right")))
    scale = np.max(np.abs(y[:n])) or 1.0
    g, xty, yty = running.upto(n)
    move = _standardising(g, n)
    g, xty, yty = move.T @ g @ move, move.T @ xty / scale, yty / scale**2
    span = max(running.d[n - 1], 1.0)
    x = np.hstack([_trend_design(running.d[test] / span), effects[test]]) @ move
    out = np.empty((len(grid), len(test)))
    history = int(running.d[n - 1]) + 1
    weights, usual = running.penalties(grid, history)
    block, rest = slice(0, N_TREND), slice(N_TREND, None)
    known = None
    # candidates that share the mode and the changepoint scale share the noise, and a ratio model's trend
    for (mode, _), own in running.alike(grid):
        first = usual[own[0]]
        if mode == "additive":
            ridge = _noise(g, xty, yty, n, first) * weights[own] + 1e-9
            out[own] = _ridge_path(g, xty, ridge) @ x.T
            continue
        if known is None:
            known = _trend_design(running.d[:n] / span)
        ridge = _noise(g[block, block], xty[block], yty, n, first[block]) * weights[own[:1], block] + 1e-9
        slope = _ridge_path(g[block, block], xty[block], ridge)[0]
        bounded = lambda v: np.where(np.abs(v) > 1e-6, v, 1e-6)
        ratio = y[:n] / scale / bounded(known @ slope) - 1.0
        # the regressors' columns are centred and scaled: so are their products with the ratio
        rty = np.diag(move)[rest] * (effects[:n].T @ ratio) + move[0, rest] * ratio.sum()
        ridge = _noise(g[rest, rest], rty, float(ratio @ ratio), n, first[rest]) * weights[own][:, rest] + 1e-9
        out[own] = bounded(x[:, block] @ slope) * (1.0 + _ridge_path(g[rest, rest], rty, ridge) @ x[:, rest].T)
    return test, out * scale


def _rolling(
    series: DataFrame, keys: Sequence[str], grid: Sequence[Mapping], initial: int, period: int,
    horizon: int, value: str, parts: int, detail: bool,
) -> DataFrame:
    """Rolling-origin forecasts of every candidate, summed per horizon day unless ``detail``.

    A cutoff's training rows are a prefix of its series, so a series (at most
    one row per day) is sent once and its cutoffs are walked there, over running sums; joining
    rows to cutoffs would square the data. ``parts`` may spread the cutoffs of a single
    long series over several tasks, each with its own copy of it.
    """
    names = list(keys)
    rows = series.select(
        *names, F.unix_date("date").alias("_day"), F.col(value).cast("double").alias("_y"), "effects"
    ).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    head = key_fields(series, keys)
    if detail:
        fields = [("cutoff", T.DateType()), ("date", T.DateType()), ("grid_id", T.IntegerType()),
                  ("actual", T.DoubleType()), ("predicted", T.DoubleType())]
    else:
        fields = [("grid_id", T.IntegerType()), ("horizon_day", T.IntegerType()), ("n", T.LongType()),
                  ("se", T.DoubleType()), ("ae", T.DoubleType()), ("ape", T.DoubleType()),
                  ("n_ape", T.LongType())]
    columns = [*names, *[f for f, _ in fields]]
    ids = np.array([c["grid_id"] for c in grid])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["_y"].notna()].sort_values("_day")
        if pdf.empty:
            return pd.DataFrame(columns=columns)
        key = tuple(pdf[names].iloc[0])
        day, y = pdf["_day"].to_numpy(), pdf["_y"].to_numpy()
        effects = np.stack(pdf["effects"].to_numpy()).astype(float)
        running = RunningGram(day, y, effects)
        cutoffs = range(day[-1] - horizon, day[0] + initial - 1, -period)
        out, sums = [], np.zeros((len(grid), horizon, 5))
        # from the earliest on: the running sums only grow
        for cutoff in reversed(cutoffs[int(pdf["_part"].iloc[0])::parts]):
            test, predicted = _fold_forecasts(running, day, cutoff, horizon, grid)
            if detail:
                at, when = pd.Timestamp(0) + pd.Timedelta(days=int(cutoff)), day[test]
                for i, g in enumerate(ids):
                    out += [
                        (*key, at.date(), (pd.Timestamp(0) + pd.Timedelta(days=int(d))).date(), int(g),
                         float(a), float(p))
                        for d, a, p in zip(when, y[test], predicted[i])
                    ]
                continue
            error = np.abs(y[test] - predicted)
            known = y[test] != 0
            ape = np.divide(error, np.abs(y[test]), out=np.zeros_like(error), where=known)
            at = day[test] - cutoff - 1
            parts_of = (np.ones_like(error), error**2, error, ape, np.broadcast_to(known, error.shape))
            for column, amount in enumerate(parts_of):
                sums[:, at, column] += amount
        if not detail:
            out = [
                (*key, int(g), h + 1, int(s[0]), s[1], s[2], s[3], int(s[4]))
                for i, g in enumerate(ids) for h, s in enumerate(sums[i]) if s[0]
            ]
        return pd.DataFrame(out, columns=columns)

    schema = T.StructType([*head, *[T.StructField(n, t) for n, t in fields]])
    return spread(rows, [*names, "_part"]).groupBy(*names, "_part").applyInPandas(walk, schema)


def _grid_rows(values: Mapping[str, Sequence]) -> list[dict]:
    """The candidates in grid order (the last name varies fastest)."""
    rows: list[dict] = [{}]
    for name, options in values.items():
        rows = [{**r, name: x} for r in rows for x in options]
    return [{**r, "grid_id": i} for i, r in enumerate(rows)]


def rolling_forecasts(
    series: DataFrame,
    parameters: Mapping[str, float | str] = STRUCTURAL_DEFAULTS,
    keys: Sequence[str] = TOTAL,
    initial: int = 20, period: int = 5, horizon: int = HORIZON,
    value: str = "total_sales", parts: int = 1,
) -> DataFrame:
    """(keys, cutoff, date, actual, predicted) for every cutoff."""
    grid = [{**parameters, "grid_id": 0}]
    return _rolling(series, keys, grid, initial, period, horizon, value, parts, True).drop("grid_id")


def by_horizon(rolled: DataFrame, keys: Sequence[str] = TOTAL) -> DataFrame:
    """rmse, mae, mape per horizon day over all cutoffs."""
    distance = F.datediff("date", "cutoff").alias("horizon_day")
    return evaluate(rolled.select(*keys, distance, "actual", "predicted"), [*keys, "horizon_day"]).select(
        *keys, "horizon_day", "n", "rmse", "mae", "mape"
    )


def cross_validate(
    series: DataFrame, keys: Sequence[str] = TOTAL, **options
) -> tuple[DataFrame, DataFrame]:
    """(metrics per horizon day, their means per series)."""
    per_day = by_horizon(rolling_forecasts(series, keys=keys, **options), keys)
    means = per_day.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("rmse", "mae", "mape")])
    return per_day, means


def search_parameters(
    series: DataFrame,
    keys: Sequence[str] = TOTAL,
    values: Mapping[str, Sequence] = STRUCTURAL_GRID,
    initial: int = 30, period: int = 7, horizon: int = HORIZON,
    value: str = "total_sales", parts: int = 1,
) -> DataFrame:
    """(keys, grid_id, parameters, rmse, mae, mape) of every combination, per series."""
    sums = _rolling(series, keys, _grid_rows(values), initial, period, horizon, value, parts, False)
    total = {c: F.sum(c) for c in ("n", "se", "ae", "ape", "n_ape")}
    per_day = sums.groupBy(*keys, "grid_id", "horizon_day").agg(
        F.sqrt(total["se"] / total["n"]).alias("rmse"),
        (total["ae"] / total["n"]).alias("mae"),
        (100.0 * F.try_divide(total["ape"], total["n_ape"])).alias("mape"),
    )
    means = per_day.groupBy(*keys, "grid_id").agg(*[F.avg(c).alias(c) for c in ("rmse", "mae", "mape")])
    # the parameters follow from grid_id: nested literal arrays, no join
    columns, step = {}, 1
    for name, options in reversed(values.items()):
        index = F.floor(F.col("grid_id") / step) % len(options)
        columns[name] = F.array(*[F.lit(x) for x in options])[index]
        step *= len(options)
    return means.withColumns(columns).select(*keys, "grid_id", *values, "rmse", "mae", "mape")


def best_parameters(searched: DataFrame, keys: Sequence[str] = TOTAL, metric: str = "rmse") -> DataFrame:
    return best_candidate(searched, metric, keys)


def train(
    series: DataFrame,
    keys: Sequence[str] = TOTAL,
    horizon: int = HORIZON,
    exogenous: DataFrame | None = None,
    holidays: Holidays = MODEL_HOLIDAYS,
    events: Holidays = SPECIAL_EVENTS,
    optimise: bool = True,
    parts: int = 1,
    prior: str = "laplace",
    samples: int = SAMPLES,
) -> dict[str, DataFrame]:
    """Parameters (searched or default), fit, forecast with components, changepoints.

    The search scores the Gaussian approximation of the changepoint prior; the fit has ``prior``. The
    interval of the forecast is from ``samples`` simulated futures.
    """
    rows = with_effects(series, holidays, exogenous, events)
    out: dict[str, DataFrame] = {}
    chosen: DataFrame | Mapping = STRUCTURAL_DEFAULTS
    if optimise:
        out["search"] = cut_lineage(search_parameters(rows, keys, horizon=horizon, parts=parts))
        chosen = out["parameters"] = best_parameters(out["search"], keys)
    coefficients = fit(rows, chosen, keys, prior=prior)
    future = future_dates(series, horizon, keys).drop("step")
    ahead = with_effects(future, holidays, exogenous, events)
    out["coefficients"] = coefficients
    out["forecast"] = with_simulated_interval(predict(coefficients, ahead, keys), coefficients, keys, samples)
    out["changepoints"] = changepoints(coefficients, keys)
    return out


def evaluate_holdout(
    series: DataFrame,
    keys: Sequence[str] = TOTAL,
    days: int = HOLDOUT_DAYS,
    exogenous: DataFrame | None = None,
    holidays: Holidays = MODEL_HOLIDAYS,
    events: Holidays = SPECIAL_EVENTS,
    optimise: bool = False,
    parts: int = 1,
    prior: str = "laplace",
) -> tuple[DataFrame, DataFrame]:
    """(scored rows, metrics per series); parameters and fit see the training rows only."""
    split = holdout_split(with_effects(series, holidays, exogenous, events), days, keys)
    known = split.filter("split = 'train'").drop("split")
    test = split.filter("split = 'test'").drop("split")
    chosen: DataFrame | Mapping = STRUCTURAL_DEFAULTS
    if optimise:
        chosen = cut_lineage(best_parameters(
            search_parameters(known, keys, horizon=days + 1, parts=parts), keys))
    predicted = predict(fit(known, chosen, keys, prior=prior), test, keys)
    actual = test.select(*keys, "date", F.col("total_sales").alias("actual"))
    scored = predicted.join(actual, [*keys, "date"]).select(
        *keys, "model", "date", "actual", F.col("yhat").alias("predicted")
    )
    return scored, evaluate(scored, [*keys, "model"])


def run(
    series: DataFrame,
    keys: Sequence[str] = TOTAL,
    horizon: int = HORIZON,
    evaluate_model: bool = True,
    cross_validation: bool = True,
    **options,
) -> dict[str, DataFrame]:
    """Everything :func:`train` gives, with holdout and cross-validation tables."""
    out = train(series, keys, horizon, **options)
    if evaluate_model:
        out["holdout"], out["metrics"] = evaluate_holdout(series, keys, **options)
    if cross_validation:
        inputs = {k: v for k, v in options.items() if k in ("holidays", "exogenous", "events")}
        out["cv_by_horizon"], out["cv_average"] = cross_validate(
            with_effects(series, **inputs), keys, horizon=horizon, parts=options.get("parts", 1))
    return out
