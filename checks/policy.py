"""Metrics, ensemble, inventory, grids, diagnostics and reporting queries.

The forecasts checked against SQL are three plain stand-ins for the model
families: the same weekday of the last week, the mean of the last 7 rows and
the mean of the last 14 rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.base import (
    EVENTS,
    HOLIDAYS,
    oracle,
    panel_series,
    register,
    sql_dates,
    total_series,
)
from checks.tables import _DOW_SQL, _MONTH_SQL, _TOTAL_LAGS, FOURIER_SQL, _flag_sql
from demandspark.functions import formatting as fmt
from demandspark.functions import metrics as mx
from demandspark.functions import stats
from demandspark.operators import aggregates as agg
from demandspark.operators import diagnostics as diag
from demandspark.operators.loess import decompose_loess
from demandspark.operators import ensemble as ens
from demandspark.operators import grids, inventory, panel
from demandspark.operators import regressors as reg
from demandspark.operators.aggregates import daily_total
from demandspark.plans import dashboard as dash
from demandspark.plans import planning, report
from demandspark.schema import DESIGN_COLUMNS, MODELS, SERIES_KEYS
from demandspark.sources import retail


# --- stand-in forecasts -----------------------------------------------------

def standin_forecasts(series: DataFrame, keys=(), horizon: int = 7) -> DataFrame:
    """(keys, model, date, yhat) for the days after each series."""
    tail = panel.last_rows(series, 14, keys).withColumn(
        "_rn", F.row_number().over(panel.Window.partitionBy(*keys).orderBy(F.col("date").desc())))
    y = F.col("total_sales")
    stat = tail.groupBy(*keys).agg(
        F.max("date").alias("_last"),
        F.avg(F.when(F.col("_rn") <= 7, y)).alias("_m7"),
        F.avg(y).alias("_m14"),
        F.map_from_entries(F.collect_list(F.struct("_rn", "total_sales"))).alias("_by_rn"),
    )
    steps = stat.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    seasonal = F.try_element_at("_by_rn", 7 - (F.col("_step") - 1) % 7)
    return steps.withColumn("_m1", seasonal).selectExpr(
        *keys, "date_add(_last, _step) AS date",
        "stack(3, 'arima', _m1, 'prophet', _m7, 'lstm', _m14) AS (model, yhat)",
    ).filter("yhat IS NOT NULL")


def standin_sql(name: str, source: str, keys: str = "", horizon: int = 7) -> str:
    names = keys.split()
    k = "".join(f"{x}, " for x in names)
    part = f"PARTITION BY {', '.join(names)} " if names else ""
    group = f" GROUP BY {', '.join(names)}" if names else ""
    on = "".join(f" AND t.{x} = s.{x}" for x in names)
    sk = "".join(f"s.{x}, " for x in names)
    steps = f"(SELECT CAST(unnest(range(1, {horizon + 1})) AS INT) AS step) g"
    return f"""
{name}_tail AS (SELECT {k}date, total_sales, row_number() OVER ({part}ORDER BY date DESC) AS rn
  FROM {source} QUALIFY rn <= 14),
{name}_stat AS (SELECT {k}max(date) AS last, avg(total_sales) FILTER (WHERE rn <= 7) AS m7,
  avg(total_sales) AS m14 FROM {name}_tail{group}),
{name} AS (
  SELECT {sk}'arima' AS model, s.last + step AS date, t.total_sales AS yhat
  FROM {name}_stat s CROSS JOIN {steps} JOIN {name}_tail t ON t.rn = 7 - (step - 1) % 7{on}
  UNION ALL SELECT {sk}'prophet', s.last + step, m7 FROM {name}_stat s CROSS JOIN {steps}
  UNION ALL SELECT {sk}'lstm', s.last + step, m14 FROM {name}_stat s CROSS JOIN {steps})"""


def ensemble_sql(name: str, source: str, keys: str = "") -> str:
    k = "".join(f"{x}, " for x in keys.split())
    picks = ", ".join(f"max(yhat) FILTER (WHERE model = '{m}') AS {m}_forecast" for m in MODELS)
    return f"""
{name} AS (SELECT *, (arima_forecast + prophet_forecast + lstm_forecast) / 3.0 AS ensemble_forecast
  FROM (SELECT {k}date, {picks} FROM {source} GROUP BY {k}date))"""


def recommend_sql(z: str = "1.645", ordering: float = 50.0, holding: float = 0.25,
                  cost: float = 10.0) -> str:
    return f"""SELECT *, greatest(economic_order_quantity, CAST(min_order_quantity AS DOUBLE))
      AS recommended_order_quantity FROM (
    SELECT *, daily_demand * lead_time_days + safety_stock AS reorder_point,
      sqrt(2.0 * daily_demand * 365.0 * {ordering} / ({cost} * {holding})) AS economic_order_quantity
    FROM (SELECT *, {z} * demand_sd * sqrt(lead_time_days) AS safety_stock FROM joined))"""


TOTAL_FC = standin_sql("fc", "daily")
TOTAL_ENS = TOTAL_FC + "," + ensemble_sql("ens", "fc")
PRODUCT_DAILY = """
product_daily AS (SELECT product_id, date, sum(sales_quantity) AS total_sales FROM sales
  GROUP BY product_id, date)"""
PRODUCT_ENS = (PRODUCT_DAILY + "," + standin_sql("pfc", "product_daily", "product_id") + ","
               + ensemble_sql("pens", "pfc", "product_id"))
TOTAL_REC = TOTAL_ENS + f""",
joined AS (SELECT p.*, s.* FROM products p, (SELECT avg(ensemble_forecast) AS daily_demand,
  stddev_samp(ensemble_forecast) AS demand_sd, CAST(count(*) AS INT) AS forecast_horizon FROM ens) s),
rec AS ({recommend_sql()})"""
PRODUCT_REC = PRODUCT_ENS + f""",
joined AS (SELECT p.*, s.daily_demand, s.demand_sd, s.forecast_horizon FROM products p LEFT JOIN
  (SELECT product_id, avg(ensemble_forecast) AS daily_demand, stddev_samp(ensemble_forecast) AS demand_sd,
   CAST(count(*) AS INT) AS forecast_horizon FROM pens GROUP BY product_id) s ON s.product_id = p.product_id),
rec AS ({recommend_sql()})"""
ENS_COLUMNS = "arima_forecast prophet_forecast lstm_forecast ensemble_forecast"
REC_COLUMNS = """product_id, product_name, lead_time_days, safety_stock, reorder_point,
  economic_order_quantity, recommended_order_quantity, min_order_quantity, forecast_horizon"""
REC_DOUBLES = "safety_stock reorder_point economic_order_quantity recommended_order_quantity"


def total_ensemble(spark, sf):
    return ens.ensemble_frame(standin_forecasts(total_series(spark, sf)))


def total_recommendations(spark, sf):
    return inventory.recommendations(total_ensemble(spark, sf), retail.products(spark, sf))


def product_series(spark, sf):
    return daily_total(retail.sales(spark, sf), ("product_id",))


# holdout: train on the rows before (last date - 7), score the 8 days from there on
HOLDOUT = """
cut AS (SELECT max(date) - 7 AS c FROM daily),
train AS (SELECT * FROM daily WHERE date < (SELECT c FROM cut)),""" + standin_sql("hfc", "train", "", 8) + """,
scored AS (SELECT model, h.date, d.total_sales AS actual, yhat AS predicted
  FROM hfc h JOIN daily d ON d.date = h.date)"""
METRICS_SQL = """count(actual - predicted) AS n, sqrt(avg((actual - predicted) ** 2)) AS rmse,
  avg(abs(actual - predicted)) AS mae, 100 * avg(abs((actual - predicted) / nullif(actual, 0))) AS mape,
  200 * avg(abs(actual - predicted) / nullif(abs(actual) + abs(predicted), 0)) AS smape,
  1 - sum((actual - predicted) ** 2) / nullif(var_pop(actual) * count(actual), 0) AS r_squared,
  count(*) FILTER (WHERE actual = 0) AS n_undefined"""
METRIC_DOUBLES = "rmse mae mape smape r_squared"
HOLDOUT_METRICS = HOLDOUT + f",\nmetrics AS (SELECT model, {METRICS_SQL} FROM scored GROUP BY model)"


def scored_holdout(spark, sf):
    split = panel.holdout_split(total_series(spark, sf), keys=())
    forecasts = standin_forecasts(split.filter("split = 'train'").drop("split"), (), 8)
    test = split.filter("split = 'test'").select("date", F.col("total_sales").alias("actual"))
    return forecasts.join(test, "date").select("model", "date", "actual", F.col("yhat").alias("predicted"))


def holdout_metrics(spark, sf):
    return mx.evaluate(scored_holdout(spark, sf), ("model",))


# one-step errors of the same-weekday forecast: residuals for the diagnostics
RESIDUALS = """
residuals AS (SELECT date, total_sales - lag7 AS residual FROM
  (SELECT date, total_sales, lag(total_sales, 7) OVER (ORDER BY date) AS lag7 FROM daily)
  WHERE lag7 IS NOT NULL)"""
PANEL_RESIDUALS = """
presiduals AS (SELECT product_id, store_id, date, sales_quantity - lag7 AS residual FROM (SELECT *,
  lag(sales_quantity, 7) OVER (PARTITION BY product_id, store_id ORDER BY date) AS lag7 FROM sales)
  WHERE lag7 IS NOT NULL)"""


def total_residuals(spark, sf):
    lagged = panel.with_lags(total_series(spark, sf), "total_sales", (7,), ())
    return lagged.filter("lag7 IS NOT NULL").select(
        "date", (F.col("total_sales") - F.col("lag7")).alias("residual"))


def panel_residuals(spark, sf):
    lagged = panel.with_lags(panel_series(spark, sf), "total_sales", (7,))
    return lagged.filter("lag7 IS NOT NULL").select(
        *SERIES_KEYS, "date", (F.col("total_sales") - F.col("lag7")).alias("residual"))


# --- metrics ----------------------------------------------------------------

@register("x1_x5_holdout_metrics", oracle("SELECT * FROM metrics", extra=HOLDOUT_METRICS,
                                          doubles=METRIC_DOUBLES))
def _(spark, sf):
    return holdout_metrics(spark, sf)


@register("x1_x5_metrics_per_series", oracle(
    f"""SELECT product_id, store_id, {METRICS_SQL} FROM (SELECT product_id, store_id, sales_quantity AS actual,
    lag(sales_quantity, 7) OVER (PARTITION BY product_id, store_id ORDER BY date) AS predicted FROM sales)
    WHERE predicted IS NOT NULL GROUP BY ALL""", doubles=METRIC_DOUBLES))
def _(spark, sf):
    lagged = panel.with_lags(panel_series(spark, sf), "total_sales", (7,))
    pairs = lagged.filter("lag7 IS NOT NULL").withColumnsRenamed({"total_sales": "actual", "lag7": "predicted"})
    return mx.evaluate(pairs, SERIES_KEYS)


@register("x6_accuracy", oracle(
    "SELECT model, 100 - mape AS accuracy, greatest(0.0, least(100.0, 100 - mape)) AS clamped FROM metrics",
    extra=HOLDOUT_METRICS, doubles="accuracy clamped"))
def _(spark, sf):
    mape = F.col("mape")
    return holdout_metrics(spark, sf).select(
        "model", mx.accuracy(mape).alias("accuracy"), mx.accuracy(mape, True).alias("clamped"))


# --- ensemble ---------------------------------------------------------------

@register("e1_first_future_values", oracle(
    """SELECT product_id, model, date, yhat FROM (SELECT *, row_number() OVER
    (PARTITION BY product_id, model ORDER BY date) AS rn FROM pfc) WHERE rn <= 5""",
    extra=PRODUCT_ENS, doubles="yhat", dates="date"))
def _(spark, sf):
    series = product_series(spark, sf)
    forecasts = standin_forecasts(series, ("product_id",))
    history = series.select("product_id", "date", F.lit("arima").alias("model"),
                            F.col("total_sales").alias("yhat"))
    return ens.first_future_values(forecasts.unionByName(history), series, 5, ("product_id",))


@register("e2_j3_mean_ensemble", oracle("SELECT * FROM pens", extra=PRODUCT_ENS,
                                        doubles=ENS_COLUMNS, dates="date"))
def _(spark, sf):
    return ens.ensemble_frame(standin_forecasts(product_series(spark, sf), ("product_id",)), ("product_id",))


@register("e3_weighted_ensemble", oracle(
    """SELECT date, (arima_forecast * 2 + prophet_forecast + lstm_forecast) / 4 AS ensemble_forecast FROM ens""",
    extra=TOTAL_ENS, doubles="ensemble_forecast", dates="date"))
def _(spark, sf):
    weights = {"arima": 2.0, "prophet": 1.0, "lstm": 1.0}
    return ens.weighted_ensemble(standin_forecasts(total_series(spark, sf)), weights)


# --- inventory --------------------------------------------------------------

LEVELS = [0.001, 0.01, 0.25, 0.5, 0.9, 0.95, 0.975, 0.99, 0.999]


def _poly(coefficients, x: str) -> str:
    return reduce(lambda acc, c: f"(({acc}) * {x} + ({c!r}))", coefficients[1:], repr(coefficients[0]))


def quantile_sql(p: str) -> str:
    def tail(q: str) -> str:
        r = f"sqrt(-2.0 * ln({q}))"
        return f"({_poly(stats.ACKLAM_C, r)}) / ({_poly([*stats.ACKLAM_D, 1.0], r)})"

    c = f"({p} - 0.5)"
    middle = f"{c} * ({_poly(stats.ACKLAM_A, f'({c} * {c})')}) / ({_poly([*stats.ACKLAM_B, 1.0], f'({c} * {c})')})"
    return f"""CASE WHEN {p} < 0.02425 THEN {tail(p)} WHEN {p} > 0.97575 THEN -({tail(f'(1 - {p})')})
      ELSE {middle} END"""


@register("i1_service_level_z", oracle(
    f"""SELECT product_id, level, CASE WHEN level = 0.95 THEN 1.645 WHEN level = 0.99 THEN 2.326
      ELSE {quantile_sql("level")} END AS z
    FROM (SELECT product_id, CAST(unnest({LEVELS}) AS DOUBLE) AS level FROM products)""",
    doubles="level z"))
def _(spark, sf):
    levels = F.explode(F.array(*[F.lit(x) for x in LEVELS])).alias("level")
    df = retail.products(spark, sf).select("product_id", levels)
    return df.withColumn("z", stats.service_level_z(F.col("level")))


@register("i2_i6_policy_by_product_class", oracle(
    f"""SELECT {REC_COLUMNS} FROM ({recommend_sql(
        "CASE WHEN lead_time_days > 7 THEN 2.326 ELSE 1.645 END", 80.0, 0.2, 4.0)})""",
    extra=PRODUCT_REC, doubles=REC_DOUBLES))
def _(spark, sf):
    pid = ("product_id",)
    ensemble = ens.ensemble_frame(standin_forecasts(product_series(spark, sf), pid), pid)
    level = F.when(F.col("lead_time_days") > 7, 0.99).otherwise(0.95)
    return inventory.recommendations(
        ensemble, retail.products(spark, sf), "product", service_level=level,
        ordering_cost=80.0, holding_cost_pct=0.2, unit_cost=4.0,
    ).drop("daily_forecast", "forecast_dates")


@register("i7_recommendations_total", oracle(f"SELECT {REC_COLUMNS} FROM rec", extra=TOTAL_REC,
                                             doubles=REC_DOUBLES))
def _(spark, sf):
    return total_recommendations(spark, sf).drop("daily_forecast", "forecast_dates")


@register("i7_recommendations_by_product", oracle(f"SELECT {REC_COLUMNS} FROM rec", extra=PRODUCT_REC,
                                                  doubles=REC_DOUBLES))
def _(spark, sf):
    pid = ("product_id",)
    ensemble = ens.ensemble_frame(standin_forecasts(product_series(spark, sf), pid), pid)
    return inventory.recommendations(ensemble, retail.products(spark, sf), "product").drop(
        "daily_forecast", "forecast_dates")


@register("i8_plan_inventory", oracle(
    """SELECT r.product_id, e.date, e.ensemble_forecast AS forecast, r.reorder_point, r.product_name
    FROM rec r JOIN pens e ON e.product_id = r.product_id""",
    extra=PRODUCT_REC, doubles="forecast reorder_point", dates="date"))
def _(spark, sf):
    series = product_series(spark, sf)
    plan = planning.plan_inventory(
        standin_forecasts(series, ("product_id",)), series, retail.products(spark, sf), scope="product")
    return report.product_forecasts(plan["recommendations"])


# --- grids ------------------------------------------------------------------

@register("j4_order_grid", oracle(
    """SELECT product_id, store_id, p.v AS p, d.v AS d, q.v AS q, a.v AS seasonal_p, b.v AS seasonal_d,
      c.v AS seasonal_q, p.v + 3 * d.v + 6 * q.v + 18 * a.v + 36 * b.v + 72 * c.v AS grid_id
    FROM (SELECT DISTINCT product_id, store_id FROM sales), (SELECT CAST(unnest(range(3)) AS INT) AS v) p,
     (SELECT CAST(unnest(range(2)) AS INT) AS v) d, (SELECT CAST(unnest(range(3)) AS INT) AS v) q,
     (SELECT CAST(unnest(range(2)) AS INT) AS v) a, (SELECT CAST(unnest(range(2)) AS INT) AS v) b,
     (SELECT CAST(unnest(range(2)) AS INT) AS v) c
    WHERE NOT (p.v = 0 AND q.v = 0) AND NOT (a.v = 0 AND c.v = 0)"""))
def _(spark, sf):
    series = panel_series(spark, sf).select(*SERIES_KEYS).distinct()
    return grids.with_order_grid(series)


@register("j4_j6_best_candidate", oracle(
    """SELECT product_id, store_id, span, score FROM (SELECT *, row_number() OVER (PARTITION BY product_id, store_id
      ORDER BY score, span) AS rn FROM (
      SELECT product_id, store_id, 1 AS span, round(avg(abs(sales_quantity - l1)), 9) AS score FROM lagged GROUP BY ALL
      UNION ALL SELECT product_id, store_id, 7, round(avg(abs(sales_quantity - l7)), 9) FROM lagged GROUP BY ALL
      UNION ALL SELECT product_id, store_id, 14, round(avg(abs(sales_quantity - l14)), 9) FROM lagged GROUP BY ALL))
    WHERE rn = 1""", extra="""
lagged AS (SELECT *, lag(sales_quantity, 1) OVER w AS l1, lag(sales_quantity, 7) OVER w AS l7,
  lag(sales_quantity, 14) OVER w AS l14 FROM sales WINDOW w AS (PARTITION BY product_id, store_id ORDER BY date))""",
    doubles="score"))
def _(spark, sf):
    lagged = panel.with_lags(panel_series(spark, sf), "total_sales", (1, 7, 14))
    long = lagged.selectExpr(*SERIES_KEYS, "total_sales",
                             "stack(3, 1, lag1, 7, lag7, 14, lag14) AS (span, guess)")
    scores = long.groupBy(*SERIES_KEYS, "span").agg(
        F.round(mx.mae(F.col("total_sales"), F.col("guess")), 9).alias("score"))
    return grids.best_candidate(scores, "score", SERIES_KEYS, "span")


# --- regressors -------------------------------------------------------------

_M1_FLAGS = ", ".join([_flag_sql("is_holiday", HOLIDAYS), _flag_sql("is_day_before_holiday", HOLIDAYS, -1),
                       _flag_sql("is_day_after_holiday", HOLIDAYS, 1)])
_CALENDAR_SQL = f"{_DOW_SQL}, CAST(month(date) AS INT) AS month, {_MONTH_SQL}, {FOURIER_SQL}, {_M1_FLAGS}"
_FOURIER_NAMES = "fourier_w1 fourier_w2 fourier_w3 fourier_w4 fourier_m1 fourier_m2"


@register("m1_external_regressors", oracle(
    f"SELECT * FROM (SELECT date, total_sales, {_CALENDAR_SQL}, {_TOTAL_LAGS} FROM daily) WHERE lag30 IS NOT NULL",
    doubles=f"total_sales lag1 lag7 lag30 {_FOURIER_NAMES}", dates="date"))
def _(spark, sf):
    return reg.external_regressors(total_series(spark, sf), HOLIDAYS)


@register("m2_design_matrix", oracle(
    f"SELECT date, {', '.join(f'{c} AS x{i}' for i, c in enumerate(DESIGN_COLUMNS))} FROM "
    f"(SELECT date, {_CALENDAR_SQL} FROM daily)",
    doubles=" ".join(f"x{i}" for i in range(15)), dates="date"))
def _(spark, sf):
    df = reg.design_matrix(reg.calendar_regressors(total_series(spark, sf), HOLIDAYS))
    return df.select("date", *[F.col("xreg")[i].alias(f"x{i}") for i in range(15)])


@register("m3_future_regressors", oracle(
    f"""SELECT product_id, store_id, step, date, {_CALENDAR_SQL} FROM (
      SELECT product_id, store_id, step, last + step AS date FROM (SELECT product_id, store_id, max(date) AS last
      FROM sales GROUP BY ALL), (SELECT CAST(unnest(range(1, 8)) AS INT) AS step))""",
    doubles=_FOURIER_NAMES, dates="date"))
def _(spark, sf):
    return reg.future_regressors(panel_series(spark, sf), 7, HOLIDAYS, SERIES_KEYS)


EXOG = """
exog AS (SELECT date, 20 + 5 * sin(2 * pi() * datediff('day', DATE '2020-01-01', date) / 365) AS temperature,
  100 + sum((total_sales % 7 - 3) / 100) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS price_index,
  CAST(CAST(total_sales % 10 = 0 AS INT) AS DOUBLE) AS promotion FROM daily)"""


def exogenous_table(spark, sf):
    """Temperature wave, price walk and promotions derived from the daily totals."""
    daily = total_series(spark, sf)
    change = daily.withColumn("_change", (F.col("total_sales") % 7 - 3) / 100)
    walk = panel.with_cumulative_sum(change, "_change", "price_index", (), start=100.0)
    return walk.select(
        "date", (20.0 + reg.seasonal_temperature(F.col("date"))).alias("temperature"), "price_index",
        (F.col("total_sales") % 10 == 0).cast("double").alias("promotion"))


@register("m14_structural_regressors", oracle(
    f"""SELECT s.product_id, s.store_id, s.date, s.sales_quantity AS total_sales, temperature, price_index, promotion,
    CAST(dayofweek(s.date) + 1 AS INT) AS day_of_week,
    CAST(CAST(dayofweek(s.date) IN (0, 6) AS INT) AS DOUBLE) AS is_weekend,
    CAST(month(s.date) AS INT) AS month, CAST(quarter(s.date) AS INT) AS quarter,
    CAST(CAST(s.date IN {sql_dates(EVENTS)} AS INT) AS DOUBLE) AS special_event,
    CAST(row_number() OVER (PARTITION BY s.product_id, s.store_id ORDER BY s.date) AS INT) AS cumulative_day
    FROM sales s LEFT JOIN exog e ON e.date = s.date""",
    extra=EXOG, doubles="total_sales temperature price_index promotion", dates="date"))
def _(spark, sf):
    return reg.structural_regressors(panel_series(spark, sf), exogenous_table(spark, sf), EVENTS, SERIES_KEYS)


@register("m15_future_exogenous", oracle(
    f"""SELECT f.product_id, f.store_id, f.date, f.step,
    coalesce(e.temperature, 20 + 5 * sin(2 * pi() * datediff('day', DATE '2020-01-01', f.date) / 365)) AS temperature,
    coalesce(e.price_index, (SELECT price_index FROM exog ORDER BY date DESC LIMIT 1)) AS price_index,
    coalesce(e.promotion, 0.0) AS promotion,
    CAST(CAST(dayofweek(f.date) IN (0, 6) AS INT) AS DOUBLE) AS is_weekend,
    CAST(CAST(f.date IN {sql_dates(EVENTS)} AS INT) AS DOUBLE) AS special_event
    FROM (SELECT product_id, store_id, step, last + step AS date FROM (SELECT product_id, store_id,
      max(date) AS last FROM sales GROUP BY ALL), (SELECT CAST(unnest(range(1, 8)) AS INT) AS step)) f
    LEFT JOIN exog e ON e.date = f.date""",
    extra=EXOG, doubles="temperature price_index promotion", dates="date"))
def _(spark, sf):
    return reg.future_exogenous(panel_series(spark, sf), exogenous_table(spark, sf), 7, EVENTS, SERIES_KEYS)


# --- diagnostics ------------------------------------------------------------

def _ljung_sql(source: str, keys: str = "") -> str:
    k = "".join(f"{x}, " for x in keys.split())
    part = f"PARTITION BY {', '.join(keys.split())}" if keys else ""
    lags = ", ".join(f"lag(e, {i}) OVER ({part} ORDER BY date) AS e{i}" for i in range(1, 11))
    total = " + ".join(f"(sum(e * e{i}) / nullif(sum(e * e), 0)) ** 2 / nullif(count(*) - {i}, 0)" for i in range(1, 11))
    half = "(statistic / 2)"
    return f"""SELECT {k}n, statistic, p_value, p_value >= 0.05 AS white_noise FROM (SELECT *,
      exp(-{half}) * (1 + {half} + {half} ** 2 / 2 + {half} ** 3 / 6 + {half} ** 4 / 24) AS p_value FROM (
      SELECT {k}count(*) AS n, count(*) * (count(*) + 2) * ({total}) AS statistic FROM (
        SELECT *, {lags} FROM (SELECT *, residual - avg(residual) OVER ({part}) AS e FROM {source}))
      {'GROUP BY ' + ', '.join(keys.split()) if keys else ''}))"""


@register("m9_ljung_box", oracle(_ljung_sql("residuals"), extra=RESIDUALS, doubles="statistic p_value"))
def _(spark, sf):
    return diag.ljung_box(total_residuals(spark, sf))


@register("m9_ljung_box_per_series", oracle(_ljung_sql("presiduals", "product_id store_id"),
                                            extra=PANEL_RESIDUALS, doubles="statistic p_value"))
def _(spark, sf):
    return diag.ljung_box(panel_residuals(spark, sf), keys=SERIES_KEYS)


def _shapiro_sql() -> str:
    """Royston (1995): n = 3 exact, 4 to 11 and from 12 on by two normal approximations."""
    u = "(1 / sqrt(n))"
    erf = f"(1 - ({_poly([*reversed(stats.ERF_A)], 't')}) * t * exp(-x * x))"
    limit = "(0.459 * n - 2.273)"
    short = f"""(-ln({limit} - ln(1 - statistic)) - (0.5440 - 0.39978 * n + 0.025054 * n ** 2 - 0.0006714 * n ** 3))
      / exp(1.3822 - 0.77857 * n + 0.062767 * n ** 2 - 0.0020322 * n ** 3)"""
    return f"""SELECT product_id, store_id, n, statistic, p_value, p_value >= 0.05 AS normal, n > 5000 AS extrapolated FROM (
    SELECT *, CASE WHEN statistic IS NULL THEN NULL WHEN statistic >= 1 THEN 1
      WHEN n = 3 THEN greatest(6 / pi() * (asin(sqrt(statistic)) - asin(sqrt(0.75))), 0)
      WHEN n < 12 AND ln(1 - statistic) >= {limit} THEN 0
      ELSE 1 - CASE WHEN z >= 0 THEN 0.5 * (1 + {erf}) ELSE 0.5 * (1 - {erf}) END END AS p_value FROM (
    SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM (
    SELECT *, CASE WHEN n < 4 OR statistic >= 1 OR (n < 12 AND ln(1 - statistic) >= {limit}) THEN NULL WHEN n < 12 THEN {short}
      ELSE (ln(1 - statistic) - ({_poly(diag.LOG_MEAN, 'ln(n)')})) / exp({_poly(diag.LOG_SD, 'ln(n)')}) END AS z FROM (
    SELECT product_id, store_id, n, CASE WHEN n >= 3 THEN sum(a * residual) ** 2 / nullif(var_pop(residual) * count(*), 0) END AS statistic FROM (
    SELECT *, CASE WHEN i = n THEN a1 WHEN i = 1 THEN -a1 WHEN n > 5 AND i = n - 1 THEN a2 WHEN n > 5 AND i = 2 THEN -a2 WHEN n <= 3 THEN 0
      ELSE m / sqrt((mm - 2 * m1 ** 2 - 2 * m2 ** 2) / (1 - 2 * a1 ** 2 - 2 * a2 ** 2)) END AS a FROM (
    SELECT * REPLACE (CASE WHEN n > 5 THEN m2 ELSE 0 END AS m2), CASE WHEN n = 3 THEN sqrt(0.5) ELSE m1 / sqrt(nullif(mm, 0)) + ({_poly(diag.LAST_WEIGHT, u)}) END AS a1,
      CASE WHEN n > 5 THEN m2 / sqrt(nullif(mm, 0)) + ({_poly(diag.SECOND_WEIGHT, u)}) ELSE 0 END AS a2
    FROM (SELECT *, sum(m * m) OVER s AS mm, max(m) OVER s AS m1,
      max(m) FILTER (WHERE i = n - 1) OVER s AS m2 FROM (
      SELECT *, {quantile_sql('((i - 0.375) / (n + 0.25))')} AS m FROM (
        SELECT *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY residual) AS i,
          count(*) OVER (PARTITION BY product_id, store_id) AS n FROM presiduals))
      WINDOW s AS (PARTITION BY product_id, store_id))))
    GROUP BY product_id, store_id, n))))"""


@register("m10_shapiro_wilk", oracle(_shapiro_sql(), extra=PANEL_RESIDUALS, doubles="statistic p_value"))
def _(spark, sf):
    return diag.shapiro_wilk(panel_residuals(spark, sf), keys=SERIES_KEYS)


# groups of three to seven values: the branches for small samples
@register("m10_shapiro_small_groups", oracle(
    _shapiro_sql().replace("FROM presiduals", "FROM psmall"), extra=PANEL_RESIDUALS + """,
psmall AS (SELECT product_id || '-' || CAST(part AS VARCHAR) AS product_id, store_id, residual FROM (
  SELECT *, CAST(floor((row_number() OVER (PARTITION BY product_id, store_id ORDER BY date) - 1) / 11) AS INT) AS part,
    (row_number() OVER (PARTITION BY product_id, store_id ORDER BY date) - 1) % 11 AS place FROM presiduals)
  WHERE place <= 2 + part % 9)""", doubles="statistic p_value"))
def _(spark, sf):
    place = F.row_number().over(Window.partitionBy(*SERIES_KEYS).orderBy("date")) - 1
    parts = panel_residuals(spark, sf).withColumn("_at", place).withColumn("_part", F.floor(F.col("_at") / 11).cast("int"))
    small = parts.filter(F.col("_at") % 11 <= 2 + F.col("_part") % 9)
    named = small.withColumn("product_id", F.concat("product_id", F.lit("-"), F.col("_part").cast("string")))
    return diag.shapiro_wilk(named, keys=SERIES_KEYS)


@register("d8_decomposition", oracle(
    """SELECT date, observed, trend, mean - centre AS seasonal, observed - trend - (mean - centre) AS remainder
    FROM ph JOIN pm USING (phase) CROSS JOIN (SELECT avg(mean) AS centre FROM pm)""",
    extra="""
ph AS (SELECT date, total_sales AS observed, avg(total_sales) OVER (ORDER BY date ROWS BETWEEN 3 PRECEDING
  AND 3 FOLLOWING) AS trend, row_number() OVER (ORDER BY date) % 7 AS phase FROM daily),
pm AS (SELECT phase, avg(observed - trend) AS mean FROM ph GROUP BY phase)""",
    doubles="observed trend seasonal remainder", dates="date"))
def _(spark, sf):
    return dash.decomposition(total_series(spark, sf))


# the parts of a loess decomposition add up, and the season repeats with mean 0 over whole periods
@register("d8_loess_decomposition")
def _(spark, sf):
    return decompose_loess(panel_series(spark, sf), keys=SERIES_KEYS)


@register("d8_loess_rows", oracle(
    "SELECT product_id, store_id, date, sales_quantity AS observed, TRUE AS adds_up, TRUE AS repeats FROM sales", doubles="observed", dates="date"))
def _(spark, sf):
    parts = decompose_loess(panel_series(spark, sf), keys=SERIES_KEYS)
    whole = F.col("trend") + F.col("seasonal") + F.col("remainder")
    phase = Window.partitionBy(*SERIES_KEYS, "_phase")
    placed = parts.withColumn("_phase", F.row_number().over(Window.partitionBy(*SERIES_KEYS).orderBy("date")) % 7)
    spread = F.max("seasonal").over(phase) - F.min("seasonal").over(phase)
    return placed.select(*SERIES_KEYS, "date", "observed", (F.abs(F.col("observed") - whole) < 1e-8).alias("adds_up"), (spread < 1e-8).alias("repeats"))


# the other choices of the panel: holdout errors of the structural model, in-sample ones for the rest and unknown names
@register("d15_residuals_structural", oracle(
    """SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY date) AS INT) AS position, date,
    actual - predicted AS residual FROM scored WHERE model = 'prophet'""", extra=HOLDOUT,
    doubles="residual", dates="date"))
def _(spark, sf):
    return dash.residuals_of("prophet", total_residuals(spark, sf), scored_holdout(spark, sf), ("model",))


@register("d15_residuals_in_sample", oracle(
    """SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY date) AS INT) AS position, date, residual
    FROM residuals, (SELECT unnest(['arima', 'ensemble', 'another']) AS name)""", extra=RESIDUALS, doubles="residual", dates="date"))
def _(spark, sf):
    fitted, holdout = total_residuals(spark, sf), scored_holdout(spark, sf)
    each = [dash.residuals_of(name, fitted, holdout, ()).withColumn("name", F.lit(name)) for name in ("arima", "ensemble", "another")]
    return reduce(lambda a, b: a.unionByName(b), each)


@register("d15_residual_series", oracle(
    """SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY date) AS INT) AS position, date,
    actual - predicted AS residual FROM scored WHERE model = 'lstm'""", extra=HOLDOUT,
    doubles="residual", dates="date"))
def _(spark, sf):
    return dash.residuals_of("lstm", total_residuals(spark, sf), scored_holdout(spark, sf), ("model",))


@register("d16_residual_histogram", oracle(
    """SELECT bin, lo + bin * w AS bin_start, lo + (bin + 1) * w AS bin_end, count(*) AS count FROM (
    SELECT lo, w, CAST(least(floor((residual - lo) / w), 9) AS INT) AS bin FROM residuals,
    (SELECT min(residual) AS lo, (max(residual) - min(residual)) / 10.0 AS w FROM residuals)) GROUP BY ALL""",
    extra=RESIDUALS, doubles="bin_start bin_end"))
def _(spark, sf):
    return dash.residual_histogram(total_residuals(spark, sf))


@register("d16_histogram_per_series", oracle(
    """SELECT product_id, store_id, bin, lo + bin * w AS bin_start, lo + (bin + 1) * w AS bin_end, count(*) AS count
    FROM (SELECT r.product_id, r.store_id, lo, w, CAST(least(floor((residual - lo) / w), 9) AS INT) AS bin
    FROM presiduals r JOIN (SELECT product_id, store_id, min(residual) AS lo,
      (max(residual) - min(residual)) / 10.0 AS w FROM presiduals GROUP BY ALL) g
      ON g.product_id = r.product_id AND g.store_id = r.store_id) GROUP BY ALL""",
    extra=PANEL_RESIDUALS, doubles="bin_start bin_end"))
def _(spark, sf):
    return dash.residual_histogram(panel_residuals(spark, sf), keys=SERIES_KEYS)


@register("d17_qq_points", oracle(
    f"""SELECT product_id, store_id, position, {quantile_sql('p')} AS theoretical, residual AS sample FROM (
    SELECT *, (position - CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END) / (n + 1 - 2 * CASE WHEN n <= 10 THEN 0.375
      ELSE 0.5 END) AS p FROM (SELECT product_id, store_id, residual,
      CAST(row_number() OVER (PARTITION BY product_id, store_id ORDER BY residual) AS INT) AS position,
      CAST(count(*) OVER (PARTITION BY product_id, store_id) AS DOUBLE) AS n FROM presiduals))""",
    extra=PANEL_RESIDUALS, doubles="theoretical sample"))
def _(spark, sf):
    return dash.residual_qq(panel_residuals(spark, sf), keys=SERIES_KEYS)


# --- dashboard and report ---------------------------------------------------

@register("a7_r1_key_metrics", oracle(
    """SELECT 'Total Forecasted Sales (Next 7 Days)' AS metric, round(sum(ensemble_forecast), 2) AS value FROM ens
    UNION ALL SELECT 'Average Daily Sales (Next 7 Days)', round(avg(ensemble_forecast), 2) FROM ens""",
    extra=TOTAL_ENS, doubles="value"))
def _(spark, sf):
    return report.key_metrics(total_ensemble(spark, sf))


@register("a8_alert_count", oracle(
    "SELECT count(*) FILTER (WHERE daily_demand >= reorder_point) AS inventory_alerts FROM rec", extra=PRODUCT_REC))
def _(spark, sf):
    series = product_series(spark, sf)
    plan = planning.plan_inventory(
        standin_forecasts(series, ("product_id",)), series, retail.products(spark, sf), scope="product")
    return agg.alert_count(plan["recommendations"])


@register("d1_kpi_row", oracle(
    """SELECT (SELECT sum(total_sales) FROM daily) AS total_sales, (SELECT avg(total_sales) FROM daily) AS avg_daily_sales,
    (SELECT greatest(0.0, least(100.0, 100 - mape)) FROM metrics WHERE model = 'arima') AS forecast_accuracy,
    (SELECT count(*) FILTER (WHERE daily_demand >= reorder_point) FROM rec) AS inventory_alerts""",
    extra=TOTAL_REC + "," + HOLDOUT_METRICS, doubles="total_sales avg_daily_sales forecast_accuracy"))
def _(spark, sf):
    return dash.kpi_row(total_series(spark, sf), holdout_metrics(spark, sf), total_recommendations(spark, sf))


@register("d2_filter_choices", oracle(
    """SELECT product_name || ' (' || product_id || ')' AS label, product_id AS value FROM products
    UNION ALL SELECT 'All Products', 'all' UNION ALL SELECT store_name || ' (' || store_id || ')', store_id FROM stores
    UNION ALL SELECT 'All Stores', 'all'"""))
def _(spark, sf):
    return dash.filter_choices(
        retail.products(spark, sf), "product_id", "product_name", "All Products"
    ).unionByName(dash.filter_choices(retail.stores(spark, sf), "store_id", "store_name", "All Stores"))


@register("d3_filtered_daily_total", oracle(
    """SELECT date, sum(sales_quantity) AS total_sales FROM sales WHERE date BETWEEN DATE '1996-02-01' AND
    DATE '1998-06-30' AND product_id = 'Brand#7' AND store_id = 'ASIA' GROUP BY date""",
    doubles="total_sales", dates="date"))
def _(spark, sf):
    return daily_total(dash.filter_sales(
        retail.sales(spark, sf), "1996-02-01", "1998-06-30", "Brand#7", "ASIA"))


@register("d4_sales_trend", oracle(
    """SELECT date, 'Historical Sales' AS series, total_sales AS value FROM daily WHERE date >= DATE '2001-01-01'
    UNION ALL SELECT date, 'Forecast', ensemble_forecast FROM ens""", extra=TOTAL_ENS, doubles="value", dates="date"))
def _(spark, sf):
    return dash.sales_trend(retail.sales(spark, sf), total_ensemble(spark, sf), start="2001-01-01")


@register("d5_inventory_status", oracle(
    """SELECT product_name AS product, r.product_id, current_stock, round(reorder_point) AS reorder_point,
    CASE WHEN current_stock <= safety_stock THEN 'Critical' WHEN current_stock <= reorder_point THEN 'Reorder'
      ELSE 'OK' END AS status
    FROM rec r JOIN stock s ON s.product_id = r.product_id""", extra=PRODUCT_REC + """,
stock AS (SELECT product_id, arg_max(total_sales, date) * 10 AS current_stock FROM product_daily GROUP BY product_id)""",
    doubles="current_stock reorder_point"))
def _(spark, sf):
    series = product_series(spark, sf)
    plan = planning.plan_inventory(
        standin_forecasts(series, ("product_id",)), series, retail.products(spark, sf), scope="product")
    stock = series.groupBy("product_id").agg((F.max_by("total_sales", "date") * 10).alias("current_stock"))
    return dash.inventory_status(plan["recommendations"], stock)


@register("d6_model_forecast", oracle(
    """SELECT date, prophet_forecast AS forecast, prophet_forecast * 0.9 AS lower, prophet_forecast * 1.1 AS upper
    FROM ens""", extra=TOTAL_ENS, doubles="forecast lower upper", dates="date"))
def _(spark, sf):
    return dash.model_forecast(total_ensemble(spark, sf), "prophet")


@register("d7_forecast_table", oracle(
    """SELECT date, round(arima_forecast, 2) AS arima, round(prophet_forecast, 2) AS prophet,
    round(lstm_forecast, 2) AS lstm, round(ensemble_forecast, 2) AS ensemble FROM ens""",
    extra=TOTAL_ENS, doubles="arima prophet lstm ensemble", dates="date"))
def _(spark, sf):
    return dash.forecast_table(total_ensemble(spark, sf))


@register("d9_recommendation_table", oracle(
    """SELECT product_id, product_name, round(safety_stock, 2) AS safety_stock, round(reorder_point, 2) AS reorder_point,
    round(recommended_order_quantity, 2) AS recommended_order_quantity, lead_time_days FROM rec""",
    extra=TOTAL_REC, doubles="safety_stock reorder_point recommended_order_quantity"))
def _(spark, sf):
    return dash.recommendation_table(total_recommendations(spark, sf))


def _planning_sql(product: str) -> str:
    return f"""SELECT product_id, product_name, date, ensemble_forecast AS forecast, reorder_point, safety_stock
      FROM rec, ens WHERE product_id = '{product}'"""


@register("d10_planning_lines", oracle(_planning_sql("Brand#12"), extra=TOTAL_REC,
                                       doubles="forecast reorder_point safety_stock", dates="date"))
def _(spark, sf):
    return dash.planning_lines(total_recommendations(spark, sf), "Brand#12")


@register("d10_planning_lines_fallback", oracle(_planning_sql("Brand#1"), extra=TOTAL_REC,
                                                doubles="forecast reorder_point safety_stock", dates="date"))
def _(spark, sf):
    return dash.planning_lines(total_recommendations(spark, sf), "unknown")


@register("d11_safety_stock_by_lead_time", oracle(
    "SELECT product_name AS product, product_id, safety_stock, lead_time_days AS lead_time FROM rec",
    extra=TOTAL_REC, doubles="safety_stock"))
def _(spark, sf):
    return dash.safety_stock_by_lead_time(total_recommendations(spark, sf))


@register("d12_order_quantities", oracle(
    """SELECT product_name AS product, product_id, 'EOQ' AS measure, economic_order_quantity AS quantity FROM rec
    UNION ALL SELECT product_name, product_id, 'MOQ', CAST(min_order_quantity AS DOUBLE) FROM rec
    UNION ALL SELECT product_name, product_id, 'Recommended', recommended_order_quantity FROM rec""",
    extra=TOTAL_REC, doubles="quantity"))
def _(spark, sf):
    return dash.order_quantities(total_recommendations(spark, sf))


_LABEL = "CASE model WHEN 'arima' THEN 'ARIMA' WHEN 'prophet' THEN 'Prophet' ELSE 'LSTM' END"


@register("d13_model_comparison", oracle(
    " UNION ALL ".join(f"SELECT {_LABEL} AS model, '{m.upper()}' AS metric, {m} AS value FROM metrics"
                       for m in ("rmse", "mae", "mape")), extra=HOLDOUT_METRICS, doubles="value"))
def _(spark, sf):
    return dash.model_comparison(holdout_metrics(spark, sf))


@register("d14_performance_table", oracle(
    f"""SELECT {_LABEL} AS model, round(rmse, 2) AS rmse, round(mae, 2) AS mae, round(mape, 2) AS mape,
    round(100 - mape, 2) AS accuracy FROM metrics""", extra=HOLDOUT_METRICS, doubles="rmse mae mape accuracy"))
def _(spark, sf):
    return dash.performance_table(holdout_metrics(spark, sf))


@register("j5_r2_forecast_chart", oracle(
    """SELECT date, 'Historical' AS series, total_sales AS value FROM daily
    UNION ALL SELECT date, 'ARIMA', arima_forecast FROM ens UNION ALL SELECT date, 'Prophet', prophet_forecast FROM ens
    UNION ALL SELECT date, 'LSTM', lstm_forecast FROM ens UNION ALL SELECT date, 'Ensemble', ensemble_forecast FROM ens""",
    extra=TOTAL_ENS, doubles="value", dates="date"))
def _(spark, sf):
    return report.forecast_chart(total_series(spark, sf), total_ensemble(spark, sf))


@register("r3_product_policy", oracle(
    " UNION ALL ".join(
        f"SELECT product_id, product_name, '{label}' AS metric, round({c}, 2) AS value FROM rec"
        for label, c in (("Safety Stock", "safety_stock"), ("Reorder Point", "reorder_point"),
                         ("Economic Order Quantity", "economic_order_quantity"),
                         ("Recommended Order Quantity", "recommended_order_quantity"))),
    extra=TOTAL_REC, doubles="value"))
def _(spark, sf):
    return report.product_policy(total_recommendations(spark, sf))


@register("r3_product_forecasts", oracle(
    "SELECT product_id, product_name, date, ensemble_forecast AS forecast, reorder_point FROM rec, ens",
    extra=TOTAL_REC, doubles="forecast reorder_point", dates="date"))
def _(spark, sf):
    return report.product_forecasts(total_recommendations(spark, sf))


# --- formatting -------------------------------------------------------------

@register("f1_f3_formatting", oracle(
    """SELECT date, format('{:,.0f}', total_sales) AS whole, format('{:,.2f}', total_sales) AS two,
    '$' || format('{:,.2f}', total_sales) AS money, strftime(date, '%B %d, %Y') AS day FROM daily""", dates="date"))
def _(spark, sf):
    y = F.col("total_sales")
    return total_series(spark, sf).select(
        "date", fmt.format_number(y).alias("whole"), fmt.format_number(y, 2).alias("two"),
        fmt.format_currency(y).alias("money"), fmt.format_date(F.col("date")).alias("day"))


@register("f4_percent_change", oracle(
    """SELECT date, CASE WHEN old IS NULL OR old = 0 THEN NULL ELSE
      (CASE WHEN (new - old) / old * 100 >= 0 THEN '+' ELSE '' END)
      || printf('%.1f%%', round((new - old) / old * 100, 1)) END AS change
    FROM (SELECT date, total_sales AS new, lag(total_sales, 1) OVER (ORDER BY date) AS old FROM daily)""",
    dates="date"))
def _(spark, sf):
    lagged = panel.with_lags(total_series(spark, sf), "total_sales", (1,), ())
    return lagged.select("date", fmt.percent_change(F.col("total_sales"), F.col("lag1")).alias("change"))
