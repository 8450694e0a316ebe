"""Cleaning, calendar, panel and aggregate operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    DIRTY,
    EVENTS,
    HOLIDAYS,
    cleaned_sales,
    oracle,
    panel_series,
    raw_bundle,
    register,
    sql_dates,
    total_series,
)
from demandspark.functions import calendar as cal
from demandspark.operators import aggregates as agg
from demandspark.operators import cleaning, panel
from demandspark.plans import features
from demandspark.schema import SERIES_KEYS
from demandspark.sources import retail

SALES_COLUMNS = ("date", "product_id", "store_id", "sales_quantity", "unit_price")


# --- cleaning ---------------------------------------------------------------

CASTED = """
casted AS (SELECT * REPLACE (TRY_CAST(date AS DATE) AS date) FROM raw_sales)"""
COMPLETE = CASTED + """,
complete AS (SELECT * FROM casted WHERE date IS NOT NULL AND product_id IS NOT NULL
   AND store_id IS NOT NULL AND sales_quantity IS NOT NULL AND unit_price IS NOT NULL)"""


@register("c1_date_cast", oracle("SELECT * FROM casted", DIRTY, CASTED,
                                 "sales_quantity unit_price", "date"))
def _(spark, sf):
    return cleaning.cast_dates(raw_bundle(spark, sf)["sales"], "date")


@register("c2_missing_counts", oracle(
    "SELECT *, " + " + ".join(f"{c}_missing" for c in SALES_COLUMNS) + " AS missing_total FROM (SELECT "
    + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}_missing" for c in SALES_COLUMNS)
    + " FROM casted)", DIRTY, CASTED))
def _(spark, sf):
    return cleaning.missing_counts(cleaning.cast_dates(raw_bundle(spark, sf)["sales"], "date"))


@register("c3_complete_cases", oracle("SELECT * FROM complete", DIRTY, COMPLETE,
                                      "sales_quantity unit_price", "date"))
def _(spark, sf):
    return cleaning.complete_cases(cleaning.cast_dates(raw_bundle(spark, sf)["sales"], "date"))


@register("c4_duplicate_count", oracle(
    "SELECT (SELECT count(*) FROM complete) - (SELECT count(*) FROM (SELECT DISTINCT * FROM complete))"
    " AS duplicates", DIRTY, COMPLETE))
def _(spark, sf):
    whole = cleaning.complete_cases(cleaning.cast_dates(raw_bundle(spark, sf)["sales"], "date"))
    return cleaning.duplicate_count(whole)


@register("c5_distinct", oracle("SELECT DISTINCT * FROM raw_sales", DIRTY,
                                doubles="sales_quantity unit_price"))
def _(spark, sf):
    return raw_bundle(spark, sf)["sales"].distinct()


@register("c6_sales_amount", oracle("SELECT *, sales_quantity * unit_price AS sales_amount FROM sales",
                                    doubles="sales_quantity unit_price sales_amount", dates="date"))
def _(spark, sf):
    return cleaning.with_sales_amount(retail.sales(spark, sf))


@register("c7_clean_sales", oracle(
    "SELECT DISTINCT *, sales_quantity * unit_price AS sales_amount FROM complete", DIRTY, COMPLETE,
    "sales_quantity unit_price sales_amount", "date"))
def _(spark, sf):
    return cleaning.clean_sales(raw_bundle(spark, sf)["sales"])


@register("c8_clean_products", oracle("SELECT * FROM raw_products WHERE lead_time_days IS NOT NULL", DIRTY))
def _(spark, sf):
    return cleaning.clean_products(raw_bundle(spark, sf)["products"])


@register("c9_clean_stores", oracle(
    "SELECT * FROM (SELECT * REPLACE (TRY_CAST(opening_date AS DATE) AS opening_date) FROM raw_stores)"
    " WHERE opening_date IS NOT NULL", DIRTY, dates="opening_date"))
def _(spark, sf):
    return cleaning.clean_stores(raw_bundle(spark, sf)["stores"])


def _quality_sql(table: str, source: str, columns: str, dedupe: bool) -> str:
    cells = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in columns.split())
    whole = " AND ".join(f"{c} IS NOT NULL" for c in columns.split())
    kept = f"(SELECT count(*) FROM (SELECT {'DISTINCT' if dedupe else ''} * FROM {source} WHERE {whole}))"
    return f"""SELECT '{table}' AS table_name, count(*) AS rows_in,
      CAST(sum({cells}) AS BIGINT) AS missing_cells,
      count(*) FILTER (WHERE NOT ({whole})) AS incomplete_rows,
      count(*) FILTER (WHERE {whole}) - {kept} AS duplicate_rows, {kept} AS rows_out FROM {source}"""


@register("c10_quality_report", oracle(
    _quality_sql("sales", "casted", " ".join(SALES_COLUMNS), True) + " UNION ALL "
    + _quality_sql("products", "raw_products", "product_id product_name category supplier "
                   "lead_time_days min_order_quantity", False) + " UNION ALL "
    + _quality_sql("stores", "(SELECT * REPLACE (TRY_CAST(opening_date AS DATE) AS opening_date) "
                   "FROM raw_stores)", "store_id store_name location size_sqft opening_date", False),
    DIRTY, CASTED))
def _(spark, sf):
    return cleaning.quality_report(raw_bundle(spark, sf))


# --- calendar ---------------------------------------------------------------

DATE_PARTS = """CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month,
  CAST(day(date) AS INT) AS day, strftime(date, '%a') AS day_of_week,
  CAST(weekofyear(date) AS INT) AS week_of_year,
  CAST(dayofweek(date) IN (0, 6) AS INT) AS is_weekend, CAST(quarter(date) AS INT) AS quarter"""


@register("t1_t4_date_parts", oracle(
    f"SELECT date, product_id, store_id, sales_quantity, {DATE_PARTS},"
    " CAST(dayofweek(date) + 1 AS INT) AS weekday_number FROM sales",
    doubles="sales_quantity", dates="date"))
def _(spark, sf):
    df = retail.sales(spark, sf).drop("unit_price")
    return cal.with_date_parts(df).withColumn("weekday_number", cal.weekday_number(F.col("date")))


def _flag_sql(name: str, dates, shift: int = 0) -> str:
    day = f"date - {shift}" if shift else "date"
    return f"CAST(CAST({day} IN {sql_dates(dates)} AS INT) AS DOUBLE) AS {name}"


@register("t5_t6_holiday_flags", oracle(
    "SELECT date, product_id, store_id, " + _flag_sql("is_holiday", HOLIDAYS) + ", "
    + _flag_sql("is_day_before_holiday", HOLIDAYS, -1) + ", "
    + _flag_sql("is_day_after_holiday", HOLIDAYS, 1) + " FROM sales", dates="date"))
def _(spark, sf):
    keys = retail.sales(spark, sf).select("date", "product_id", "store_id")
    return cal.with_holiday_flags(keys, HOLIDAYS)


def _calendar_table(spark, sf):
    """A holiday table read from the data: New Year and Independence Day of every year sold."""
    fixed = ((F.month("date") == 1) & (F.dayofmonth("date") == 1)) | (
        (F.month("date") == 7) & (F.dayofmonth("date") == 4))
    return total_series(spark, sf).filter(fixed).select(
        F.lit("custom").alias("holiday"), F.col("date").alias("ds"),
        F.lit(-1).alias("lower_window"), F.lit(1).alias("upper_window"))


@register("t5_holiday_table_join", oracle(
    "SELECT date, total_sales, CAST(CAST((month(date), day(date)) IN ((1, 1), (7, 4)) AS INT) AS DOUBLE)"
    " AS is_holiday FROM daily", doubles="total_sales", dates="date"))
def _(spark, sf):
    table = _calendar_table(spark, sf).withColumnRenamed("ds", "date")
    return cal.with_date_flag(total_series(spark, sf), table, "is_holiday")


@register("t7_holiday_window", oracle(
    """SELECT 'custom' AS holiday, date AS holiday_date, CAST(o AS INT) AS "offset",
    CAST(date + CAST(o AS INT) AS DATE) AS ds
    FROM daily, (VALUES (-1), (0), (1)) AS w(o)
    WHERE (month(date), day(date)) IN ((1, 1), (7, 4))""", dates="holiday_date ds"))
def _(spark, sf):
    return cal.expand_holiday_windows(_calendar_table(spark, sf))


@register("t8_special_events", oracle(
    "SELECT date, total_sales, " + _flag_sql("special_event", EVENTS) + " FROM daily",
    doubles="total_sales", dates="date"))
def _(spark, sf):
    return cal.with_date_flag(total_series(spark, sf), EVENTS, "special_event")


_DOW_SQL = ", ".join(
    f"CAST(CAST(dayofweek(date) = {i} AS INT) AS DOUBLE) AS is_{n}" for i, n in enumerate(cal.WEEKDAYS))
_MONTH_SQL = ", ".join(
    f"CAST(CAST(month(date) = {m} AS INT) AS DOUBLE) AS is_month_{m}" for m in range(1, 13))


@register("t9_t10_dummies", oracle(
    f"SELECT date, {_DOW_SQL}, CAST(month(date) AS INT) AS month, {_MONTH_SQL} FROM daily", dates="date"))
def _(spark, sf):
    df = total_series(spark, sf).select("date")
    return cal.with_month_dummies(cal.with_weekday_dummies(df))


_EPOCH = "datediff('day', DATE '1970-01-01', date)"
_FOURIER = {
    "fourier_w1": f"sin(2 * pi() * {_EPOCH} / 7)",
    "fourier_w2": f"cos(2 * pi() * {_EPOCH} / 7)",
    "fourier_w3": f"sin(4 * pi() * {_EPOCH} / 7)",
    "fourier_w4": f"cos(4 * pi() * {_EPOCH} / 7)",
    "fourier_m1": f"sin(2 * pi() * {_EPOCH} / 30.44)",
    "fourier_m2": f"cos(2 * pi() * {_EPOCH} / 30.44)",
}
FOURIER_SQL = ", ".join(f"{sql} AS {name}" for name, sql in _FOURIER.items())


@register("t11_fourier", oracle(f"SELECT date, {FOURIER_SQL} FROM daily",
                                doubles=" ".join(_FOURIER), dates="date"))
def _(spark, sf):
    return cal.with_fourier_terms(total_series(spark, sf).select("date"))


@register("t12_row_sequence", oracle(
    """SELECT product_id, store_id, date, sales_quantity AS total_sales,
    CAST(row_number() OVER (PARTITION BY product_id, store_id ORDER BY date) AS INT) AS cumulative_day
    FROM sales""", doubles="total_sales", dates="date"))
def _(spark, sf):
    return panel.with_row_sequence(panel_series(spark, sf))


@register("t13_report_range", oracle(
    """SELECT date AS end_date, period, CAST(CASE period WHEN 'daily' THEN date - INTERVAL 1 DAY
      WHEN 'monthly' THEN date - INTERVAL 1 MONTH WHEN 'quarterly' THEN date - INTERVAL 3 MONTH
      WHEN 'yearly' THEN date - INTERVAL 1 YEAR ELSE date - INTERVAL 7 DAY END AS DATE) AS start_date
    FROM daily, (VALUES ('daily'), ('weekly'), ('monthly'), ('quarterly'), ('yearly'), ('other')) AS p(period)""",
    dates="end_date start_date"))
def _(spark, sf):
    names = [F.lit(x) for x in ("daily", "weekly", "monthly", "quarterly", "yearly", "other")]
    ends = total_series(spark, sf).select(
        F.col("date").alias("end_date"), F.explode(F.array(*names)).alias("period"))
    start, _end = cal.report_range(F.col("period"), F.col("end_date"))
    return ends.withColumn("start_date", start)


@register("t14_future_dates", oracle(
    """SELECT product_id, store_id, CAST(last + CAST(step AS INT) AS DATE) AS date, CAST(step AS INT) AS step
    FROM (SELECT product_id, store_id, max(date) AS last FROM sales GROUP BY ALL),
         (SELECT unnest(range(1, 8)) AS step)""", dates="date"))
def _(spark, sf):
    return panel.future_dates(retail.sales(spark, sf))


# --- panel ------------------------------------------------------------------

@register("w1_panel_violations", oracle(
    "SELECT product_id, store_id, date, count(*) AS copies FROM raw_sales GROUP BY ALL HAVING count(*) > 1",
    DIRTY))
def _(spark, sf):
    return panel.panel_violations(raw_bundle(spark, sf)["sales"])


_OVER = "OVER (PARTITION BY product_id, store_id ORDER BY date"
_LAGS = ", ".join(f"lag(sales_quantity, {n}) {_OVER}) AS sales_lag{n}" for n in (1, 7))
_MEANS = ", ".join(
    f"avg(sales_quantity) {_OVER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS sales_ma{n}"
    for n in (7, 14))


@register("w2_w3_lags_and_trailing_means", oracle(
    f"SELECT *, {_LAGS}, {_MEANS} FROM sales",
    doubles="sales_quantity unit_price sales_lag1 sales_lag7 sales_ma7 sales_ma14", dates="date"))
def _(spark, sf):
    return features.lag_features(retail.sales(spark, sf))


_TOTAL_LAGS = ", ".join(f"lag(total_sales, {n}) OVER (ORDER BY date) AS lag{n}" for n in (1, 7, 30))


@register("w4_total_lags", oracle(f"SELECT *, {_TOTAL_LAGS} FROM daily",
                                  doubles="total_sales lag1 lag7 lag30", dates="date"))
def _(spark, sf):
    return panel.with_lags(total_series(spark, sf), "total_sales", (1, 7, 30), ())


@register("w5_drop_incomplete_lag", oracle(
    f"SELECT * FROM (SELECT *, {_TOTAL_LAGS} FROM daily) WHERE lag30 IS NOT NULL",
    doubles="total_sales lag1 lag7 lag30", dates="date"))
def _(spark, sf):
    return panel.drop_incomplete_lag(
        panel.with_lags(total_series(spark, sf), "total_sales", (1, 7, 30), ()))


@register("w6_cumulative_sum", oracle(
    f"""SELECT product_id, store_id, date, sales_quantity AS total_sales,
    100 + sum(sales_quantity) {_OVER} ROWS UNBOUNDED PRECEDING) AS running FROM sales""",
    doubles="total_sales running", dates="date"))
def _(spark, sf):
    return panel.with_cumulative_sum(panel_series(spark, sf), "total_sales", "running", start=100.0)


def _ranked(direction: str) -> str:
    return f"""SELECT product_id, store_id, date, sales_quantity AS total_sales FROM (SELECT *,
      row_number() OVER (PARTITION BY product_id, store_id ORDER BY date {direction}) AS rn FROM sales)
      WHERE rn <= 7"""


@register("w7_last_rows", oracle(_ranked("DESC"), doubles="total_sales", dates="date"))
def _(spark, sf):
    return panel.last_rows(panel_series(spark, sf), 7)


@register("w7_first_rows", oracle(_ranked("ASC"), doubles="total_sales", dates="date"))
def _(spark, sf):
    return panel.first_rows(panel_series(spark, sf), 7)


_SEQ = ", ".join(f"lag(sales_quantity, {8 - i}) {_OVER}) AS x{i}" for i in range(1, 8))


@register("w8_sequence_windows", oracle(
    f"""SELECT * FROM (SELECT product_id, store_id, date, {_SEQ}, sales_quantity AS label FROM sales)
    WHERE x1 IS NOT NULL""", doubles=" ".join(f"x{i}" for i in range(1, 8)) + " label", dates="date"))
def _(spark, sf):
    seq = panel.sequence_windows(panel_series(spark, sf), "total_sales")
    cells = [F.col("sequence")[i - 1].alias(f"x{i}") for i in range(1, 8)]
    return seq.select(*SERIES_KEYS, "date", *cells, "label")


@register("w9_chronological_split", oracle(
    f"""SELECT product_id, store_id, date, sales_quantity AS total_sales,
    CASE WHEN row_number() {_OVER}) <= floor(count(*) OVER (PARTITION BY product_id, store_id) * 0.8)
    THEN 'train' ELSE 'validation' END AS split FROM sales""", doubles="total_sales", dates="date"))
def _(spark, sf):
    return panel.chronological_split(panel_series(spark, sf))


@register("w10_holdout_split", oracle(
    """SELECT product_id, store_id, date, sales_quantity AS total_sales,
    CASE WHEN date < max(date) OVER (PARTITION BY product_id, store_id) - 7
    THEN 'train' ELSE 'test' END AS split FROM sales""", doubles="total_sales", dates="date"))
def _(spark, sf):
    return panel.holdout_split(panel_series(spark, sf))


_FOLDS = f"""
placed AS (SELECT product_id, store_id, date, sales_quantity AS total_sales, f AS fold, n, fs, rn,
    n - (5 - f + 1) * fs + 1 AS test_start, least(n - (5 - f) * fs, n) AS test_end
  FROM (SELECT *, row_number() {_OVER}) AS rn, n // 5 AS fs FROM
        (SELECT *, count(*) OVER (PARTITION BY product_id, store_id) AS n FROM sales)),
       (SELECT CAST(unnest(range(1, 6)) AS INT) AS f))"""


@register("w11_expanding_folds", oracle(
    """SELECT product_id, store_id, date, total_sales, fold,
    CASE WHEN rn < test_start THEN 'train' ELSE 'test' END AS split
    FROM placed WHERE fs > 0 AND test_start > 1 AND rn <= test_end""",
    extra=_FOLDS, doubles="total_sales", dates="date"))
def _(spark, sf):
    return panel.expanding_folds(panel_series(spark, sf))


_CUTOFFS = """
span AS (SELECT product_id, store_id, min(date) AS a, max(date) AS b FROM sales GROUP BY ALL),
cutoffs AS (SELECT product_id, store_id, CAST(b - 7 - 5 * CAST(j AS INT) AS DATE) AS cutoff
  FROM span, (SELECT unnest(range(0, 2000)) AS j) WHERE b - 7 - 5 * CAST(j AS INT) >= a + 20)"""


@register("w12_rolling_cutoffs", oracle("SELECT * FROM cutoffs", extra=_CUTOFFS, dates="cutoff"))
def _(spark, sf):
    return panel.rolling_cutoffs(panel_series(spark, sf), 20, 5, 7)


@register("w12_rolling_test_rows", oracle(
    """SELECT s.product_id, s.store_id, s.date, s.sales_quantity AS total_sales, c.cutoff
    FROM sales s JOIN cutoffs c ON s.product_id = c.product_id AND s.store_id = c.store_id
     AND s.date > c.cutoff AND s.date <= c.cutoff + 7""",
    extra=_CUTOFFS, doubles="total_sales", dates="date cutoff"))
def _(spark, sf):
    return panel.rolling_test_rows(panel_series(spark, sf), 20, 5, 7)


@register("w13_normalisation", oracle(
    """SELECT product_id, store_id, avg(sales_quantity) AS mean, stddev_samp(sales_quantity) AS sd
    FROM sales GROUP BY ALL""", doubles="mean sd"))
def _(spark, sf):
    return panel.normalisation(panel_series(spark, sf), "total_sales")


@register("w13_standardise", oracle(
    """SELECT *, normalised * sd + mean AS restored FROM (
    SELECT *, (total_sales - mean) / sd AS normalised FROM (
      SELECT product_id, store_id, date, sales_quantity AS total_sales,
      avg(sales_quantity) OVER (PARTITION BY product_id, store_id) AS mean,
      stddev_samp(sales_quantity) OVER (PARTITION BY product_id, store_id) AS sd FROM sales))""",
    doubles="total_sales mean sd normalised restored", dates="date"))
def _(spark, sf):
    df = panel.standardise(panel_series(spark, sf), "total_sales")
    return df.withColumn("restored", panel.denormalise(F.col("normalised"), F.col("mean"), F.col("sd")))


@register("w2_fill_gaps", oracle(
    """SELECT d.product_id, d.store_id, d.date, coalesce(s.sales_quantity, 0.0) AS total_sales FROM (
      SELECT product_id, store_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE)
      AS date FROM sales GROUP BY product_id, store_id) d
    LEFT JOIN sales s ON s.product_id = d.product_id AND s.store_id = d.store_id AND s.date = d.date""",
    doubles="total_sales", dates="date"))
def _(spark, sf):
    return panel.fill_gaps(panel_series(spark, sf), "total_sales")


# --- aggregates and features ------------------------------------------------

@register("a1_daily_total", oracle("SELECT * FROM daily", doubles="total_sales", dates="date"))
def _(spark, sf):
    return total_series(spark, sf)


@register("a2_structural_shape", oracle("SELECT date AS ds, total_sales AS y FROM daily",
                                        doubles="y", dates="ds"))
def _(spark, sf):
    return agg.structural_shape(total_series(spark, sf))


@register("a3_full_features", oracle(
    f"SELECT *, {DATE_PARTS}, {_flag_sql('is_holiday', HOLIDAYS)}, {_LAGS}, {_MEANS} FROM "
    "(SELECT *, sales_quantity * unit_price AS sales_amount FROM sales)",
    doubles="sales_quantity unit_price sales_amount sales_lag1 sales_lag7 sales_ma7 sales_ma14",
    dates="date"))
def _(spark, sf):
    tables = {**retail.bundle(spark, sf), "sales": cleaned_sales(spark, sf)}
    return features.engineer_features(tables, HOLIDAYS)["full_features"]


def _performance_sql(key: str, dim: str) -> str:
    return f"""SELECT t.total_sales, t.total_revenue, t.{key}, d.* EXCLUDE ({key}) FROM (
      SELECT {key}, sum(sales_quantity) AS total_sales, sum(sales_quantity * unit_price) AS total_revenue
      FROM sales GROUP BY {key}) t LEFT JOIN {dim} d ON d.{key} = t.{key}"""


@register("a4_product_performance", oracle(_performance_sql("product_id", "products"),
                                           doubles="total_sales total_revenue", digits=2), digits=2)
def _(spark, sf):
    return agg.product_performance(cleaned_sales(spark, sf), retail.products(spark, sf))


@register("a5_store_performance", oracle(_performance_sql("store_id", "stores"),
                                         doubles="total_sales total_revenue", dates="opening_date",
                                         digits=2), digits=2)
def _(spark, sf):
    return agg.store_performance(cleaned_sales(spark, sf), retail.stores(spark, sf))


@register("a6_sales_kpis", oracle(
    "SELECT sum(total_sales) AS total_sales, avg(total_sales) AS avg_daily_sales FROM daily",
    doubles="total_sales avg_daily_sales"))
def _(spark, sf):
    return agg.sales_kpis(total_series(spark, sf))


@register("j1_left_join_keeps_unmatched", oracle(
    """SELECT t.product_id, t.total_sales, d.product_name FROM
      (SELECT product_id, sum(sales_quantity) AS total_sales FROM sales GROUP BY product_id) t
      LEFT JOIN (SELECT * FROM products WHERE lead_time_days > 7) d ON d.product_id = t.product_id""",
    doubles="total_sales"))
def _(spark, sf):
    some = retail.products(spark, sf).filter("lead_time_days > 7")
    return agg.product_performance(cleaned_sales(spark, sf), some).select(
        "product_id", "total_sales", "product_name")


@register("j2_membership", oracle(
    f"SELECT * FROM daily WHERE date IN {sql_dates(HOLIDAYS)}", doubles="total_sales", dates="date"))
def _(spark, sf):
    flagged = cal.with_date_flag(total_series(spark, sf), HOLIDAYS, "is_holiday")
    return flagged.filter("is_holiday = 1").drop("is_holiday")
