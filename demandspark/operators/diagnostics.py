"""Residual diagnostics and decomposition, per series.

Windows here run over one series (at most one row per day). For the total
series (no keys) pass daily rows, never the fact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandspark.functions.stats import (
    chi2_upper_tail_even,
    normal_cdf,
    normal_quantile,
    polynomial,
)
from demandspark.operators.panel import series_window, whole_series
from demandspark.schema import KPSS_LIMIT, SEASONAL_PERIOD, STRENGTH_LIMIT, TOTAL

# ---------------------------------------------------------------------------
# Coefficients published by Royston (1995), highest power first.
# ---------------------------------------------------------------------------
LAST_WEIGHT = [-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0]
SECOND_WEIGHT = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0]
LOG_MEAN = [0.0038915, -0.083751, -0.31082, -1.5861]
LOG_SD = [0.0030302, -0.082676, -0.4803]
# 4 to 11 values
SHORT_MEAN = [-6.714e-4, 0.025054, -0.39978, 0.5440]
SHORT_SD = [-0.0020322, 0.062767, -0.77857, 1.3822]
SHORT_LIMIT = [0.459, -2.273]


def ljung_box(
    df: DataFrame, value: str = "residual", lags: int = 10, keys: Sequence[str] = TOTAL,
    index: str = "date", alpha: float = 0.05,
) -> DataFrame:
    """(keys, n, statistic, p_value, white_noise)."""
    w = series_window(keys, index)
    clean = df.filter(F.col(value).isNotNull())
    centred = clean.withColumn("_e", F.col(value) - F.avg(value).over(whole_series(keys)))
    lagged = centred.withColumns({f"_e{k}": F.lag("_e", k).over(w) for k in range(1, lags + 1)})
    e = F.col("_e")
    sums = lagged.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(e * e).alias("_c0"),
        *[F.sum(e * F.col(f"_e{k}")).alias(f"_c{k}") for k in range(1, lags + 1)],
    )
    n = F.col("n").cast("double")
    total = F.lit(0.0)
    for k in range(1, lags + 1):
        r = F.try_divide(F.col(f"_c{k}"), F.col("_c0"))
        total = total + F.try_divide(r * r, n - k)
    return (
        sums.withColumn("statistic", n * (n + 2.0) * total)
        .withColumn("p_value", chi2_upper_tail_even(F.col("statistic"), lags))
        .select(*keys, "n", "statistic", "p_value", (F.col("p_value") >= alpha).alias("white_noise"))
    )


def shapiro_wilk(
    df: DataFrame, value: str = "residual", keys: Sequence[str] = TOTAL, alpha: float = 0.05,
    largest: int = 5000,
) -> DataFrame:
    """(keys, n, statistic, p_value, normal, extrapolated); NULL for fewer than three or equal values.

    Exact for three values, Royston's approximation above; it was published for up to
    ``largest`` values, and beyond them the row is marked ``extrapolated``.
    """
    w = Window.partitionBy(*keys).orderBy(value)
    n, i = F.col("n"), F.col("_i")
    ranked = (
        df.filter(F.col(value).isNotNull())
        .withColumn("_i", F.row_number().over(w))
        .withColumn("n", F.count("*").over(whole_series(keys)))
        .withColumn("_m", normal_quantile((i - 0.375) / (n + 0.25)))
    )
    x, m = F.col(value), F.col("_m")
    # only the two largest weights are corrected; by symmetry so are the two smallest
    sums = ranked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.sum(m * m).alias("mm"),
        F.sum(m * x).alias("mx"),
        (F.var_pop(x) * F.count(x)).alias("ss"),
        F.max(F.when(i == n, m)).alias("m1"),
        F.max(F.when(i == n - 1, m)).alias("m2"),
        F.max(F.when(i == n, x)).alias("hi1"),
        F.max(F.when(i == n - 1, x)).alias("hi2"),
        F.max(F.when(i == 1, x)).alias("lo1"),
        F.max(F.when(i == 2, x)).alias("lo2"),
    )
    usable = n >= 3
    root = n.cast("double")
    u = 1.0 / F.sqrt(root)
    mm, m1, m2 = F.when(usable, F.col("mm")), F.col("m1"), F.col("m2")
    a1 = F.when(n == 3, F.lit(0.5**0.5)).otherwise(m1 / F.sqrt(mm) + polynomial(LAST_WEIGHT, u))
    # up to five values only the largest weight is corrected, so the second counts as an inner one
    m2 = F.when(n > 5, m2).otherwise(0.0)
    a2 = F.when(n > 5, m2 / F.sqrt(mm) + polynomial(SECOND_WEIGHT, u)).otherwise(0.0)
    phi = (mm - 2.0 * m1 * m1 - 2.0 * m2 * m2) / (1.0 - 2.0 * F.col("a1") ** 2 - 2.0 * F.col("a2") ** 2)
    span1 = F.col("hi1") - F.col("lo1")
    span2 = F.col("hi2") - F.col("lo2")
    # the middle one of three values has no weight
    inner = F.when(n > 3, F.try_divide(F.col("mx") - m1 * span1 - m2 * span2, F.sqrt("phi"))).otherwise(0.0)
    weighted = F.col("a1") * span1 + F.col("a2") * span2 + inner
    size = F.ln(root)
    w, left = F.col("statistic"), F.ln(1.0 - F.col("statistic"))
    z = (left - polynomial(LOG_MEAN, size)) / F.exp(polynomial(LOG_SD, size))
    limit = polynomial(SHORT_LIMIT, root)
    short_z = (-F.ln(limit - left) - polynomial(SHORT_MEAN, root)) / F.exp(polynomial(SHORT_SD, root))
    exact = F.greatest((F.asin(F.sqrt(w)) - F.asin(F.sqrt(F.lit(0.75)))) * (6.0 / math.pi), F.lit(0.0))
    p_value = (
        F.when(w.isNull(), None)
        .when(w >= 1.0, 1.0)
        .when(n == 3, exact)
        .when((n < 12) & (left >= limit), 0.0)
        .when(n < 12, 1.0 - normal_cdf(short_z))
        .otherwise(1.0 - normal_cdf(z))
    )
    fit = (
        sums.withColumns({"a1": F.when(usable, a1), "a2": F.when(usable, a2)})
        .withColumn("phi", F.when(n > 3, phi))
        .withColumn("statistic", F.when(usable, F.try_divide(weighted * weighted, F.col("ss"))))
        .withColumn("p_value", p_value)
    )
    return fit.select(
        *keys, "n", "statistic", "p_value", (F.col("p_value") >= alpha).alias("normal"), (n > largest).alias("extrapolated"))


def kpss(
    df: DataFrame, value: str = "total_sales", keys: Sequence[str] = TOTAL, index: str = "date", largest_lag: int = 24,
) -> DataFrame:
    """(keys, n, statistic, stationary): is the level stationary (Kwiatkowski et al. 1992)?

    Bartlett weights up to lag trunc(4 (n/100)^(1/4)), which reaches ``largest_lag`` only at over
    150,000 days; ``stationary`` is at the 5% point. A constant series has statistic 0.
    """
    if largest_lag < 1:
        raise ValueError("largest_lag must be positive")
    w, e, n = series_window(keys, index), F.col("_e"), F.col("n")
    centred = df.filter(F.col(value).isNotNull()).withColumn("_e", F.col(value) - F.avg(value).over(whole_series(keys)))
    running = F.sum(e).over(w.rowsBetween(Window.unboundedPreceding, 0))
    lagged = {f"_c{j}": e * F.lag(e, j).over(w) for j in range(1, largest_lag + 1)}
    sums = centred.withColumns({"_s": running, **lagged}).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col("_s") ** 2).alias("_ss"), F.sum(e * e).alias("_c0"), F.sum(F.col(value) ** 2).alias("_yy"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in lagged])
    lags = F.floor(4.0 * F.pow(n / 100.0, F.lit(0.25)))
    long_run = F.col("_c0")
    for j in range(1, largest_lag + 1):
        long_run = long_run + F.when(lags >= j, 2.0 * (1.0 - j / (lags + 1.0)) * F.col(f"_c{j}")).otherwise(0.0)
    statistic = F.when(long_run > 1e-12 * F.col("_yy"), F.col("_ss") / (n * long_run)).otherwise(0.0)
    return sums.withColumn("statistic", statistic).select(*keys, "n", "statistic", (F.col("statistic") <= KPSS_LIMIT).alias("stationary"))


def seasonal_strength(
    df: DataFrame, value: str = "total_sales", period: int = SEASONAL_PERIOD, keys: Sequence[str] = TOTAL, index: str = "date",
) -> DataFrame:
    """(keys, n, strength, seasonal): 1 - var(remainder) / var(seasonal + remainder), at least 0.

    ``seasonal`` says whether it asks for a seasonal difference. A series without variation has strength 0.
    """
    parts = decompose(df, value, period, keys, index)
    sums = parts.groupBy(*keys).agg(
        F.count("*").alias("n"), F.var_samp("remainder").alias("_r"), F.var_samp(F.col("seasonal") + F.col("remainder")).alias("_a"),
        F.sum(F.col("observed") ** 2).alias("_yy"))
    strength = F.when(F.col("_a") > 1e-12 * F.col("_yy"), F.greatest(F.lit(0.0), 1.0 - F.col("_r") / F.col("_a"))).otherwise(0.0)
    return sums.withColumn("strength", strength).select(*keys, "n", "strength", (F.col("strength") > STRENGTH_LIMIT).alias("seasonal"))


def decompose(
    df: DataFrame, value: str = "total_sales", period: int = SEASONAL_PERIOD,
    keys: Sequence[str] = TOTAL, index: str = "date",
) -> DataFrame:
    """Classical additive decomposition; observed = trend + seasonal + remainder.

    Trend is the centred moving mean (odd period), shortened at both ends so
    that every row has one. The seasonal part is the mean of the detrended
    values per phase (row position modulo period), centred on zero.
    """
    if period % 2 == 0:
        raise ValueError("period must be odd")
    half = period // 2
    w = series_window(keys, index)
    phased = df.withColumns(
        {
            "observed": F.col(value),
            "trend": F.avg(value).over(w.rowsBetween(-half, half)),
            "_phase": F.row_number().over(w) % period,
        }
    ).withColumn("_detrended", F.col("observed") - F.col("trend"))
    by_phase = phased.withColumn(
        "_mean", F.avg("_detrended").over(Window.partitionBy(*keys, "_phase"))
    )
    # every phase counts once in the centre, however many rows it has
    weight = F.lit(1.0) / F.count("*").over(Window.partitionBy(*keys, "_phase"))
    centred = by_phase.withColumn("_w", weight).withColumn(
        "_centre",
        F.sum(F.col("_mean") * F.col("_w")).over(whole_series(keys))
        / F.sum("_w").over(whole_series(keys)),
    )
    return centred.withColumn("seasonal", F.col("_mean") - F.col("_centre")).select(
        *keys,
        index,
        "observed",
        "trend",
        "seasonal",
        (F.col("observed") - F.col("trend") - F.col("seasonal")).alias("remainder"),
    )


def residual_series(
    df: DataFrame, keys: Sequence[str], index: str = "date",
    actual: str = "actual", predicted: str = "predicted",
) -> DataFrame:
    """(keys, position, date, residual), position counted from 1 in date order."""
    w = series_window(keys, index)
    return df.select(
        *keys,
        F.row_number().over(w).alias("position"),
        index,
        (F.col(actual) - F.col(predicted)).alias("residual"),
    )


def histogram(
    df: DataFrame, value: str = "residual", bins: int = 10, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, bin, bin_start, bin_end, count) with equal widths between min and max.

    The range is one row per group, joined back on the group key (or read as a
    scalar subquery without keys), so no group is gathered in one task.
    """
    x = F.col(value)
    span = df.groupBy(*keys).agg(
        F.min(x).alias("_lo"),
        ((F.max(x) - F.min(x)) / float(bins)).alias("_width"),
    )
    if keys:
        placed = df.join(span, list(keys))
    else:
        row = span.select(F.struct("_lo", "_width"))
        placed = df.withColumn("_s", row.scalar()).select("*", "_s.*").drop("_s")
    lo, width = F.col("_lo"), F.col("_width")
    number = F.coalesce(F.floor(F.try_divide(x - lo, width)), F.lit(0)).cast("int")
    return (
        placed.filter(x.isNotNull())
        .withColumn("bin", F.least(number, F.lit(bins - 1)))
        .groupBy(*keys, "bin", "_lo", "_width")
        .agg(F.count("*").alias("count"))
        .select(
            *keys,
            "bin",
            (lo + F.col("bin") * width).alias("bin_start"),
            (lo + (F.col("bin") + 1) * width).alias("bin_end"),
            "count",
        )
    )


def qq_points(df: DataFrame, keys: Sequence[str], value: str = "residual") -> DataFrame:
    """(keys, position, theoretical, sample): sorted values against normal quantiles."""
    w = Window.partitionBy(*keys).orderBy(value)
    n = F.count("*").over(Window.partitionBy(*keys))
    i = F.row_number().over(w)
    offset = F.when(F.col("_n") <= 10, 0.375).otherwise(0.5)
    p: Column = (F.col("position") - offset) / (F.col("_n") + 1.0 - 2.0 * offset)
    return (
        df.filter(F.col(value).isNotNull())
        .select(*keys, F.col(value).alias("sample"), i.alias("position"), n.alias("_n"))
        .select(*keys, "position", normal_quantile(p).alias("theoretical"), "sample")
    )
