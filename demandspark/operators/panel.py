"""Panel operators: one series per key, ordered by date.

A valid panel has at most one row per (key, date). That bounds every window
partition by the number of calendar days, however large the table is. The
total series (no keys) is only ever formed after the daily aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from demandspark.schema import (
    HOLDOUT_DAYS,
    HORIZON,
    SEQUENCE_LENGTH,
    SERIES_KEYS,
    TRAIN_FRACTION,
)

Keys = Sequence[str]


def series_window(keys: Keys, index: str = "date") -> WindowSpec:
    """The one window spec all operators share, so Spark sorts each series once."""
    return Window.partitionBy(*keys).orderBy(index)


def whole_series(keys: Keys) -> WindowSpec:
    return Window.partitionBy(*keys)


def panel_violations(df: DataFrame, keys: Keys = SERIES_KEYS, index: str = "date") -> DataFrame:
    """(key, date) pairs that occur more than once."""
    return df.groupBy(*keys, index).agg(F.count("*").alias("copies")).filter("copies > 1")


def guarded(col: Column, w: WindowSpec, index: str) -> Column:
    """``col``, or an error when the previous row of the series has the same date.

    Runs inside the window the caller needs anyway: no extra shuffle.
    """
    again = F.lag(index).over(w) == F.col(index)
    message = F.lit(f"series key and {index} do not identify a row: remove or sum copies first")
    return F.when(again, F.raise_error(message)).otherwise(col)


def with_lags(
    df: DataFrame,
    value: str,
    lags: Iterable[int],
    keys: Keys = SERIES_KEYS,
    index: str = "date",
    prefix: str = "lag",
) -> DataFrame:
    """Lags by row position; leading values are NULL."""
    w = series_window(keys, index)
    return df.withColumns({f"{prefix}{n}": guarded(F.lag(value, n).over(w), w, index) for n in lags})


def with_trailing_means(
    df: DataFrame,
    value: str,
    spans: Iterable[int],
    keys: Keys = SERIES_KEYS,
    index: str = "date",
    prefix: str = "ma",
) -> DataFrame:
    """Mean of the last ``span`` rows, this one included; short at the start."""
    w = series_window(keys, index)
    return df.withColumns(
        {f"{prefix}{n}": guarded(F.avg(value).over(w.rowsBetween(-(n - 1), 0)), w, index) for n in spans}
    )


def drop_incomplete_lag(df: DataFrame, lag_column: str = "lag30") -> DataFrame:
    return df.filter(F.col(lag_column).isNotNull())


def with_cumulative_sum(
    df: DataFrame, value: str, name: str, keys: Keys = SERIES_KEYS,
    index: str = "date", start: float = 0.0,
) -> DataFrame:
    w = series_window(keys, index)
    running = guarded(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), w, index)
    return df.withColumn(name, running + F.lit(start))


def with_row_sequence(
    df: DataFrame, keys: Keys = SERIES_KEYS, index: str = "date", name: str = "cumulative_day"
) -> DataFrame:
    return df.withColumn(name, F.row_number().over(series_window(keys, index)))


def last_rows(df: DataFrame, n: int, keys: Keys = SERIES_KEYS, index: str = "date") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(index).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def first_rows(df: DataFrame, n: int, keys: Keys = SERIES_KEYS, index: str = "date") -> DataFrame:
    w = series_window(keys, index)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def sequence_windows(
    df: DataFrame,
    value: str,
    length: int = SEQUENCE_LENGTH,
    keys: Keys = SERIES_KEYS,
    index: str = "date",
) -> DataFrame:
    """(keys, date, sequence, label): the ``length`` values before each row, and its own."""
    w = series_window(keys, index)
    past = F.collect_list(value).over(w.rowsBetween(-length, -1))
    return (
        df.select(*keys, index, guarded(past, w, index).alias("sequence"), F.col(value).alias("label"))
        .filter(F.size("sequence") == length)
    )


def chronological_split(
    df: DataFrame,
    fraction: float = TRAIN_FRACTION,
    keys: Keys = SERIES_KEYS,
    index: str = "date",
    name: str = "split",
) -> DataFrame:
    position = F.row_number().over(series_window(keys, index))
    size = F.count("*").over(whole_series(keys))
    return df.withColumn(
        name, F.when(position <= F.floor(size * fraction), "train").otherwise("validation")
    )


def holdout_split(
    df: DataFrame,
    days: int = HOLDOUT_DAYS,
    keys: Keys = SERIES_KEYS,
    index: str = "date",
    name: str = "split",
) -> DataFrame:
    """Test rows are those at or after (last date - days): days + 1 dates if none is missing."""
    last = F.max(index).over(whole_series(keys))
    return df.withColumn(
        name, F.when(F.col(index) < F.date_sub(last, days), "train").otherwise("test")
    )


def expanding_folds(
    df: DataFrame, k: int = 5, keys: Keys = SERIES_KEYS, index: str = "date"
) -> DataFrame:
    """Expanding-window folds: adds ``fold`` and ``split``; k bounded copies per row.

    Fold i tests one of the last k equal blocks and trains on all rows before
    it. A fold that would have no training row is left out.
    """
    n, size = F.col("_n"), F.col("_size")
    placed = (
        df.withColumn("_rn", F.row_number().over(series_window(keys, index)))
        .withColumn("_n", F.count("*").over(whole_series(keys)))
        .withColumn("_size", F.floor(n / k))
        .withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
        .withColumn("_start", n - (k - F.col("fold") + 1) * size + 1)
        .withColumn("_end", F.least(n - (k - F.col("fold")) * size, n))
        .filter((size > 0) & (F.col("_start") > 1) & (F.col("_rn") <= F.col("_end")))
    )
    split = F.when(F.col("_rn") < F.col("_start"), "train").otherwise("test")
    return placed.withColumn("split", split).drop("_rn", "_n", "_size", "_start", "_end")


def rolling_cutoffs(
    df: DataFrame,
    initial: int,
    period: int,
    horizon: int,
    keys: Keys = SERIES_KEYS,
    index: str = "date",
) -> DataFrame:
    """(keys, cutoff): last date - horizon, stepping back while >= first date + initial."""
    span = df.groupBy(*keys).agg(F.min(index).alias("_first"), F.max(index).alias("_last"))
    room = F.datediff("_last", "_first") - horizon - initial
    return (
        span.filter(room >= 0)
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.floor(room / period).cast("int"))))
        .select(*keys, F.expr(f"date_sub(_last, {horizon} + _j * {period})").alias("cutoff"))
    )


def rolling_test_rows(
    df: DataFrame,
    initial: int,
    period: int,
    horizon: int,
    keys: Keys = SERIES_KEYS,
    index: str = "date",
) -> DataFrame:
    """Rows with every ``cutoff`` whose horizon covers them (cutoff < date <= cutoff + horizon).

    The cutoffs of a row follow from its distance to the last date, so no
    range join is needed: a row is copied ceil(horizon / period) times.
    """
    w = whole_series(keys)
    back = F.datediff("_last", F.col(index))
    room = F.datediff("_last", "_first") - horizon - initial
    newest = F.greatest(F.lit(0), F.floor((back - horizon) / period) + 1).cast("int")
    oldest = F.least(F.floor(room / period), F.floor(back / period)).cast("int")
    return (
        df.withColumns({"_first": F.min(index).over(w), "_last": F.max(index).over(w)})
        .withColumns({"_lo": newest, "_hi": oldest})
        .filter((room >= 0) & (F.col("_lo") <= F.col("_hi")))
        .withColumn("_j", F.explode(F.sequence("_lo", "_hi")))
        .withColumn("cutoff", F.expr(f"date_sub(_last, {horizon} + _j * {period})"))
        .drop("_first", "_last", "_lo", "_hi", "_j")
    )


def normalisation(df: DataFrame, value: str, keys: Keys = SERIES_KEYS) -> DataFrame:
    """Mean and sample standard deviation per series."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def standardise(
    df: DataFrame, value: str, keys: Keys = SERIES_KEYS, name: str = "normalised",
    fit_on: Column | None = None,
) -> DataFrame:
    """Adds ``mean``, ``sd`` and the standardised value; ``fit_on`` limits the fitting rows."""
    source = F.col(value) if fit_on is None else F.when(fit_on, F.col(value))
    w = whole_series(keys)
    return df.withColumns(
        {"mean": F.avg(source).over(w), "sd": F.stddev_samp(source).over(w)}
    ).withColumn(name, F.try_divide(F.col(value) - F.col("mean"), F.col("sd")))


def denormalise(col: Column, mean: Column, sd: Column) -> Column:
    return col * sd + mean


def future_dates(
    df: DataFrame, horizon: int = HORIZON, keys: Keys = SERIES_KEYS, index: str = "date"
) -> DataFrame:
    """(keys, date, step): the ``horizon`` days after each series ends."""
    return (
        df.groupBy(*keys)
        .agg(F.max(index).alias("_last"))
        .filter(F.col("_last").isNotNull())
        .select(*keys, "_last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
        .select(*keys, F.expr("date_add(_last, step)").alias(index), "step")
    )


def fill_gaps(
    df: DataFrame, value: str, keys: Keys = SERIES_KEYS, index: str = "date", fill: float = 0.0
) -> DataFrame:
    """Optional date spine: every day between a series' first and last date.

    Each row is followed by its own gap, found with ``lead``; no join.
    """
    w = series_window(keys, index)
    following = F.coalesce(F.date_sub(F.lead(index).over(w), 1), F.col(index))
    return (
        df.select(*keys, F.col(index).alias("_start"), following.alias("_end"), value)
        .withColumn(index, F.explode(F.sequence("_start", "_end")))
        .select(
            *keys,
            index,
            F.when(F.col(index) == F.col("_start"), F.col(value)).otherwise(F.lit(fill)).alias(value),
        )
    )
