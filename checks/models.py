"""Forecasting models, file sources and the incremental refresh.

Solvers have no SQL counterpart: their properties are tested on fixtures in
``tests/``. Checked against SQL here are the least-squares primitive, what of a
solver's result SQL can state (series, dates, folds, candidates, scales, counts),
file round trips and the refresh.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import base, policy
from checks.base import EVENTS, HOLIDAYS, oracle, register
from checks.tables import _FOLDS
from demandspark.operators import arima, diagnostics, gram, sarimax, sequence, structural
from demandspark.operators.grids import ORDER_COLUMNS
from demandspark.schema import (
    ARIMA_RUN_GRID,
    PRODUCTS_SCHEMA,
    SALES_SCHEMA,
    SEASONAL_PERIOD,
    SERIES_KEYS,
)
from demandspark.session import cut_lineage, shared_folder
from demandspark.sources import csv, retail, stages
from demandspark.streaming import refresh

K = SERIES_KEYS
STORE = ("store_id",)


# Models read their inputs several times, so these are written once, as the
# stage tables of the weekly job are.
def panel_series(spark, sf):
    return cut_lineage(base.panel_series(spark, sf))


def store_series(spark, sf):
    return cut_lineage(base.panel_series(spark, sf).groupBy(*STORE, "date").agg(F.sum("total_sales").alias("total_sales")))


def exogenous_table(spark, sf):
    return cut_lineage(policy.exogenous_table(spark, sf))


def scratch(spark) -> str:
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


def spine_sql(model: str) -> str:
    """One row per series and day of the horizon."""
    return f"""SELECT product_id, store_id, '{model}' AS model, CAST(last + CAST(i AS INT) AS DATE) AS date
    FROM (SELECT product_id, store_id, max(date) AS last FROM sales GROUP BY ALL), (SELECT unnest(range(1, 8)) AS i)"""


def holdout_sql(model: str) -> str:
    return f"""SELECT product_id, store_id, '{model}' AS model, count(*) AS n FROM (
      SELECT *, max(date) OVER (PARTITION BY product_id, store_id) AS last FROM sales)
    WHERE date >= last - 7 GROUP BY ALL"""


def spine(forecasts):
    """Rows without a number do not count as forecasts."""
    known = F.col("yhat").isNotNull() & ~F.isnan("yhat")
    return forecasts.filter(known).select(*K, "model", "date")


# --- least squares ----------------------------------------------------------

@register("m4_gram_least_squares", oracle(
    """SELECT product_id, store_id, count(*) AS n, regr_intercept(sales_quantity, t) AS intercept,
    regr_slope(sales_quantity, t) AS slope FROM (SELECT *, row_number() OVER (PARTITION BY product_id, store_id
      ORDER BY date) / 100.0 AS t FROM sales) GROUP BY ALL""", doubles="intercept slope"))
def _(spark, sf):
    w = sarimax.series_window(K)
    rows = panel_series(spark, sf).select(
        *K, F.array(F.lit(1.0), F.row_number().over(w) / 100.0).alias("x"), F.col("total_sales").alias("y"))
    fields = [gram.T.StructField("n", gram.T.LongType())] + [
        gram.T.StructField(c, gram.T.DoubleType()) for c in ("intercept", "slope")]
    return gram.solve_per_series(
        gram.gram_partials(rows, K), K,
        lambda _key, n, xtx, xty, _yty: [(n, *gram.least_squares(xtx, xty))], fields)


# --- seasonal ARIMA ---------------------------------------------------------

def _fitted(spark, sf):
    series = panel_series(spark, sf)
    orders = cut_lineage(sarimax.best_orders(sarimax.search_orders(series, K), K))
    return sarimax.fit(sarimax.with_design(series, HOLIDAYS), orders, K)


@register("m4_sarimax_fit")
def _(spark, sf):
    return _fitted(spark, sf)[0].select(*K, *sarimax.ORDERS, "sigma2", "n_eff")


@register("m5_order_search")
def _(spark, sf):
    return sarimax.search_orders(panel_series(spark, sf), K)


def _candidates_sql() -> str:
    """Admissible orders of every series, and the rows that differencing leaves."""
    top = ARIMA_RUN_GRID
    tables, number, step = [], [], 1
    for name, column in ORDER_COLUMNS.items():
        tables.append(f"(SELECT CAST(unnest(range(0, {top[name] + 1})) AS INT) AS {column})")
        number.append(f"{column} * {step}")
        step *= top[name] + 1
    return f"""SELECT product_id, store_id, CAST({" + ".join(number)} AS INT) AS grid_id, {", ".join(ORDER_COLUMNS.values())},
    CAST(greatest(n - d - {SEASONAL_PERIOD} * seasonal_d, 0) AS BIGINT) AS n_eff
    FROM (SELECT product_id, store_id, count(*) AS n FROM sales GROUP BY ALL), {", ".join(tables)}
    WHERE p + q > 0 AND seasonal_p + seasonal_q > 0"""


@register("m5_candidates", oracle(_candidates_sql()))
def _(spark, sf):
    return sarimax.search_orders(panel_series(spark, sf), K).select(*K, "grid_id", *sarimax.ORDERS, "n_eff")


# --- exact likelihood: what SQL can state of it -----------------------------

# uneven steps, as integer sales would give rounding ties at even ones and at 0
TRIALS = [round((i + 0.37) / 10.37, 5) for i in range(-10, 10)]

# first-order autoregression with a level: the first row has variance 1 / (1 - phi^2)
_FIRST_ORDER = """
ordered AS (SELECT product_id, store_id, date, sales_quantity AS y, lag(sales_quantity) OVER (PARTITION BY product_id,
  store_id ORDER BY date) AS z FROM sales),
sums AS (SELECT product_id, store_id, count(*) AS n, max(y) FILTER (WHERE z IS NULL) AS y1, sum(y * y) FILTER (WHERE z IS NOT NULL) AS yy,
  coalesce(sum(z * z), 0) AS zz, coalesce(sum(y * z), 0) AS yz, coalesce(sum(y) FILTER (WHERE z IS NOT NULL), 0) AS sy, coalesce(sum(z), 0) AS sz
  FROM ordered GROUP BY ALL)"""


def _likelihood_sql(phi: str) -> tuple[str, str]:
    """(sum of squares, log-likelihood) at ``phi`` from the sums of a series."""
    squares = f"((1 - {phi} ** 2) * y1 ** 2 + yy - 2 * {phi} * yz + {phi} ** 2 * zz)"
    cross = f"((1 - {phi} ** 2) * y1 + (1 - {phi}) * (sy - {phi} * sz))"
    weight = f"((1 - {phi} ** 2) + (n - 1) * (1 - {phi}) ** 2)"
    rest = f"({squares} - {cross} ** 2 / {weight})"
    return rest, f"(-0.5 * (n * (ln(2 * pi() * {rest} / n) + 1) - ln(1 - {phi} ** 2)))"


@register("m4_likelihood_profile", oracle(
    f"""SELECT product_id, store_id, CAST(i AS INT) AS trial, {_likelihood_sql("phi")[0]} / n AS sigma2, {_likelihood_sql("phi")[1]} AS log_likelihood
    FROM sums, (SELECT unnest(range(0, {len(TRIALS)})) AS i, unnest({TRIALS}) AS phi)""", extra=_FIRST_ORDER, doubles="sigma2 log_likelihood", digits=3), digits=3)
def _(spark, sf):
    series = panel_series(spark, sf).withColumnRenamed("total_sales", "value")
    return arima.likelihood_profile(series, K, (1, 0, 0, 0, 0, 0), [(t,) for t in TRIALS]).drop("terms")


# golden section on the profile; the middle of the last bracket is the estimate
@register("m4_first_order_fit", oracle(
    f"""SELECT product_id, store_id, phi, {_likelihood_sql("phi")[1]} AS log_likelihood
    FROM (SELECT s.*, (g.a + g.b) / 2 AS phi FROM golden g JOIN sums s USING (product_id, store_id) WHERE g.i = 60)""",
    extra=_FIRST_ORDER + f""",
golden AS (
  SELECT 0 AS i, product_id, store_id, CAST(-0.995 AS DOUBLE) AS a, CAST(0.995 AS DOUBLE) AS b FROM sums
  UNION ALL
  SELECT i + 1, product_id, store_id, CASE WHEN at_left < at_right THEN l ELSE a END, CASE WHEN at_left < at_right THEN b ELSE r END FROM (
    SELECT i, product_id, store_id, a, b, l, r, {_likelihood_sql("l")[1]} AS at_left, {_likelihood_sql("r")[1]} AS at_right FROM (
      SELECT g.i, s.*, g.a, g.b, g.b - (g.b - g.a) * 0.6180339887498949 AS l, g.a + (g.b - g.a) * 0.6180339887498949 AS r
      FROM golden g JOIN sums s USING (product_id, store_id) WHERE g.i < 60)))""",
    doubles="phi log_likelihood", digits=3).replace("WITH sales AS", "WITH RECURSIVE sales AS", 1), digits=3)
def _(spark, sf):
    out = sarimax.fit_exact(panel_series(spark, sf), K, regressors=False, select=(1, 0, 0, 0, 0, 0), period=None)
    return out["coefficients"].select(*K, F.col("terms")[0].alias("phi"), "log_likelihood")


@register("m7_random_walk", oracle(
    """SELECT product_id, store_id, CAST(last + CAST(i AS INT) AS DATE) AS date, level AS yhat, level - 1.96 * sqrt(s2 * i) AS lower,
      level + 1.96 * sqrt(s2 * i) AS upper FROM (
      SELECT product_id, store_id, max(date) AS last, max_by(y, date) AS level, avg((y - z) ** 2) FILTER (WHERE z IS NOT NULL) AS s2
      FROM ordered GROUP BY ALL), (SELECT unnest(range(1, 8)) AS i)""", extra=_FIRST_ORDER, doubles="yhat lower upper", dates="date"))
def _(spark, sf):
    out = sarimax.fit_exact(panel_series(spark, sf), K, regressors=False, select=(0, 1, 0, 0, 0, 0), period=None)
    return out["forecast"].drop("model")


@register("m4_exact_fit")
def _(spark, sf):
    return sarimax.fit_exact(panel_series(spark, sf), K, holidays=HOLIDAYS)["coefficients"].select(
        *K, *sarimax.ORDERS, "status", "n_eff", "sigma2", "log_likelihood", "aic")


def _kpss_sql() -> str:
    lags = ", ".join(f"e * lag(e, {j}) OVER w AS c{j}" for j in range(1, 25))
    weighted = " + ".join(f"CASE WHEN lags >= {j} THEN 2 * (1 - {j} / (lags + 1)) * coalesce(sum(c{j}), 0) ELSE 0 END" for j in range(1, 25))
    return f"""SELECT product_id, store_id, n, statistic, statistic <= {arima.KPSS_LIMIT} AS stationary FROM (
      SELECT product_id, store_id, n, CASE WHEN s2 > 1e-12 * yy THEN ss / (n * s2) ELSE 0 END AS statistic FROM (
      SELECT product_id, store_id, n, sum(e * e) + {weighted} AS s2, sum(s * s) AS ss, sum(y * y) AS yy FROM (
        SELECT *, sum(e) OVER (PARTITION BY product_id, store_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS s, {lags},
          floor(4 * pow(n / 100.0, 0.25)) AS lags FROM (
          SELECT product_id, store_id, date, sales_quantity AS y, count(*) OVER p AS n, sales_quantity - avg(sales_quantity) OVER p AS e
          FROM sales WINDOW p AS (PARTITION BY product_id, store_id))
        WINDOW w AS (PARTITION BY product_id, store_id ORDER BY date)) GROUP BY product_id, store_id, n, lags))"""


@register("m6_kpss", oracle(_kpss_sql(), doubles="statistic"))
def _(spark, sf):
    return diagnostics.kpss(panel_series(spark, sf), keys=K)


@register("m6_seasonal_strength", oracle(
    f"""SELECT product_id, store_id, n, strength, strength > {arima.STRENGTH_LIMIT} AS seasonal FROM (
      SELECT product_id, store_id, count(*) AS n, CASE WHEN var_samp(left_) > 1e-12 * sum(y * y) THEN greatest(0, 1 - var_samp(left_ - mean + centre) / var_samp(left_)) ELSE 0 END AS strength
      FROM (SELECT *, avg(mean) FILTER (WHERE first_of = 1) OVER (PARTITION BY product_id, store_id) AS centre FROM (
        SELECT *, avg(left_) OVER (PARTITION BY product_id, store_id, phase) AS mean,
          row_number() OVER (PARTITION BY product_id, store_id, phase ORDER BY date) AS first_of FROM (
          SELECT product_id, store_id, date, sales_quantity AS y, row_number() OVER w % 7 AS phase, sales_quantity - avg(sales_quantity) OVER (
            PARTITION BY product_id, store_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS left_
          FROM sales WINDOW w AS (PARTITION BY product_id, store_id ORDER BY date)))) GROUP BY ALL)""", doubles="strength"))
def _(spark, sf):
    return diagnostics.seasonal_strength(panel_series(spark, sf), keys=K)


@register("m6_auto_orders")
def _(spark, sf):
    return sarimax.auto_orders(panel_series(spark, sf), K, period=7)


@register("m6_order_rows", oracle(
    "SELECT product_id, store_id, count(*) AS n, count(*) >= 8 AS chosen FROM sales GROUP BY ALL"))
def _(spark, sf):
    out = sarimax.auto_orders(panel_series(spark, sf), K, period=7, exact=False)
    return out.select(*K, "n", (F.col("p").isNotNull() & (F.col("status") == "fitted")).alias("chosen"))


@register("m7_sarimax_forecast")
def _(spark, sf):
    return sarimax.train(panel_series(spark, sf), K, holidays=HOLIDAYS)["forecast"]


@register("m7_forecast_spine", oracle(spine_sql(sarimax.MODEL), dates="date"))
def _(spark, sf):
    return spine(sarimax.train(panel_series(spark, sf), K, holidays=HOLIDAYS)["forecast"])


@register("m8_residuals")
def _(spark, sf):
    return sarimax.fit_exact(panel_series(spark, sf), K, holidays=HOLIDAYS)["fitted"].select(*K, "date", "residual")


@register("m8_residual_rows", oracle(
    "SELECT product_id, store_id, count(*) AS n, count(*) AS n_known, min(date) AS first, max(date) AS last FROM sales GROUP BY ALL", dates="first last"))
def _(spark, sf):
    return sarimax.fit_exact(panel_series(spark, sf), K, holidays=HOLIDAYS)["fitted"].groupBy(*K).agg(
        F.count("*").alias("n"), F.count("residual").alias("n_known"), F.min("date").alias("first"), F.max("date").alias("last"))


@register("m11_expanding_cv")
def _(spark, sf):
    return sarimax.cross_validate(panel_series(spark, sf), K, holidays=HOLIDAYS)[0]


@register("m11_fold_rows", oracle(
    """SELECT product_id, store_id, fold, count(*) AS n_test FROM placed
    WHERE fs > 0 AND test_start > 1 AND rn BETWEEN test_start AND test_end GROUP BY ALL""", extra=_FOLDS))
def _(spark, sf):
    return sarimax.cross_validate(panel_series(spark, sf), K, holidays=HOLIDAYS)[0].select(*K, "fold", "n_test")


@register("m12_sarimax_holdout")
def _(spark, sf):
    return sarimax.evaluate_holdout(panel_series(spark, sf), K, holidays=HOLIDAYS)[1]


@register("m12_holdout_rows", oracle(holdout_sql(sarimax.MODEL)))
def _(spark, sf):
    return sarimax.evaluate_holdout(panel_series(spark, sf), K, holidays=HOLIDAYS)[1].select(*K, "model", "n")


@register("m13_sarimax_run")
def _(spark, sf):
    out = sarimax.run(panel_series(spark, sf), K, holidays=HOLIDAYS)
    holdout = out["metrics"].select(*K, F.col("rmse").alias("holdout_rmse"))
    tests = out["ljung_box"].select(*K, F.col("p_value").alias("ljung_box_p")).join(out["shapiro"].select(*K, F.col("p_value").alias("shapiro_p")), list(K))
    return out["orders"].join(out["cv_average"], list(K), "left").join(holdout, list(K), "left").join(tests, list(K), "left")


# --- structural model -------------------------------------------------------

def _effects(spark, sf, series):
    return structural.with_effects(series, HOLIDAYS, exogenous_table(spark, sf), EVENTS)


@register("m16_structural_fit")
def _(spark, sf):
    rows = _effects(spark, sf, panel_series(spark, sf))
    return structural.fit(rows, keys=K, prior="laplace").select(*K, "first", "last", "y_scale", "seasonality_mode", "sigma")


# the Laplace fit meets its optimality conditions
@register("m16_optimality", oracle("SELECT product_id, store_id, TRUE AS optimal FROM sales GROUP BY ALL"))
def _(spark, sf):
    fitted = structural.fit(_effects(spark, sf, panel_series(spark, sf)), keys=K, prior="laplace")
    return fitted.select(*K, (F.col("breach") < 1e-6).alias("optimal"))


@register("m16_structural_scale", oracle(
    """SELECT product_id, store_id, min(date) AS first, max(date) AS last, max(abs(sales_quantity)) AS y_scale
    FROM sales GROUP BY ALL""", doubles="y_scale", dates="first last"))
def _(spark, sf):
    rows = _effects(spark, sf, panel_series(spark, sf))
    return structural.fit(rows, keys=K).select(*K, "first", "last", "y_scale")


# yhat from its own components: the default model is multiplicative
@register("m17_forecast_spine", oracle(
    f"SELECT *, TRUE AS composed FROM ({spine_sql(structural.MODEL)})", dates="date"))
def _(spark, sf):
    out = structural.train(panel_series(spark, sf), K, exogenous=exogenous_table(spark, sf),
                           holidays=HOLIDAYS, events=EVENTS, optimise=False)["forecast"]
    parts = F.col("weekly") + F.col("monthly") + F.col("holidays") + F.col("regressors")
    whole = F.col("trend") * (1.0 + parts)
    composed = F.abs(F.col("yhat") - whole) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(whole))
    return out.select(*K, "model", "date", composed.alias("composed"))


@register("m18_changepoint_dates", oracle(
    """SELECT product_id, store_id, CAST(j AS INT) AS changepoint,
      CAST(a + CAST(round(greatest(b - a, 1) * 8 * j / 250.0) AS INT) AS DATE) AS date
    FROM (SELECT product_id, store_id, min(date) AS a, max(date) AS b FROM sales GROUP BY ALL),
      (SELECT unnest(range(1, 26)) AS j)""", dates="date"))
def _(spark, sf):
    fitted = structural.fit(_effects(spark, sf, panel_series(spark, sf)), keys=K)
    return structural.changepoints(fitted, K).select(*K, "changepoint", "date")


@register("m17_structural_components")
def _(spark, sf):
    return structural.train(panel_series(spark, sf), K, exogenous=exogenous_table(spark, sf),
                            holidays=HOLIDAYS, events=EVENTS, optimise=False)["forecast"]


@register("m18_changepoints")
def _(spark, sf):
    return structural.changepoints(structural.fit(_effects(spark, sf, panel_series(spark, sf)), keys=K, prior="laplace"), K)


@register("m19_rolling_cv")
def _(spark, sf):
    return structural.cross_validate(_effects(spark, sf, panel_series(spark, sf)), K)[0]


@register("m20_parameter_search")
def _(spark, sf):
    return structural.search_parameters(_effects(spark, sf, store_series(spark, sf)), STORE)


# one row per store and combination, in the order of the grid
@register("m20_grid_rows", oracle(
    """SELECT store_id, CAST(row_number() OVER (PARTITION BY store_id ORDER BY i, j, k, l) - 1 AS INT) AS grid_id, a AS changepoint_prior_scale,
      b AS seasonality_prior_scale, c AS holidays_prior_scale, e AS seasonality_mode, TRUE AS scored
    FROM (SELECT DISTINCT store_id FROM sales),
      (SELECT unnest([1, 2, 3, 4, 5]) AS i, unnest(CAST([0.001, 0.01, 0.05, 0.1, 0.5] AS DOUBLE[])) AS a),
      (SELECT unnest([1, 2, 3, 4]) AS j, unnest(CAST([0.01, 0.1, 1.0, 10.0] AS DOUBLE[])) AS b),
      (SELECT unnest([1, 2, 3, 4]) AS k, unnest(CAST([0.01, 0.1, 1.0, 10.0] AS DOUBLE[])) AS c),
      (SELECT unnest([1, 2]) AS l, unnest(['additive', 'multiplicative']) AS e)""",
    doubles="changepoint_prior_scale seasonality_prior_scale holidays_prior_scale"))
def _(spark, sf):
    found = structural.search_parameters(_effects(spark, sf, store_series(spark, sf)), STORE)
    return found.select(*STORE, "grid_id", *structural.PARAMETERS, (F.col("rmse") >= F.col("mae") * 0.999).alias("scored"))


@register("m21_structural_train")
def _(spark, sf):
    return structural.train(store_series(spark, sf), STORE, exogenous=exogenous_table(spark, sf),
                            holidays=HOLIDAYS, events=EVENTS)["forecast"]


@register("m22_structural_holdout")
def _(spark, sf):
    return structural.evaluate_holdout(panel_series(spark, sf), K, exogenous=exogenous_table(spark, sf),
                                       holidays=HOLIDAYS, events=EVENTS)[1]


@register("m22_holdout_rows", oracle(holdout_sql(structural.MODEL)))
def _(spark, sf):
    return structural.evaluate_holdout(panel_series(spark, sf), K, exogenous=exogenous_table(spark, sf),
                                       holidays=HOLIDAYS, events=EVENTS)[1].select(*K, "model", "n")


@register("m23_structural_run")
def _(spark, sf):
    out = structural.run(panel_series(spark, sf), K, exogenous=exogenous_table(spark, sf),
                         holidays=HOLIDAYS, events=EVENTS, optimise=False)
    holdout = out["metrics"].select(*K, F.col("rmse").alias("holdout_rmse"))
    return out["cv_average"].join(holdout, list(K), "full_outer")


# --- sequence model ---------------------------------------------------------

@register("m24_sequence_training")
def _(spark, sf):
    return sequence.train(panel_series(spark, sf), K).errors


@register("m25_sequence_forecast")
def _(spark, sf):
    series = panel_series(spark, sf)
    return sequence.forecast(sequence.train(series, K), series)


@register("m25_forecast_spine", oracle(spine_sql(sequence.MODEL), dates="date"))
def _(spark, sf):
    series = panel_series(spark, sf)
    return spine(sequence.forecast(sequence.train(series, K), series))


@register("m25_tree_forecast")
def _(spark, sf):
    series = panel_series(spark, sf)
    return sequence.forecast(sequence.train(series, K, kind="trees"), series)


@register("m24_recurrent_training")
def _(spark, sf):
    return sequence.train(panel_series(spark, sf), K, kind="recurrent").history


@register("m25_recurrent_forecast")
def _(spark, sf):
    series = panel_series(spark, sf)
    return sequence.forecast(sequence.train(series, K, kind="recurrent"), series)


# windows of every series that varies: all rows but its first seven, the first 80% to learn from
@register("m24_recurrent_windows", oracle(
    """SELECT CASE WHEN i <= floor(size * 0.8) THEN 'train' ELSE 'validation' END AS split, 60 AS epoch, count(*) AS n
    FROM (SELECT i, count(*) OVER (PARTITION BY product_id, store_id) AS size FROM (
      SELECT product_id, store_id, row_number() OVER (PARTITION BY product_id, store_id ORDER BY date) - 7 AS i,
        min(sales_quantity) OVER (PARTITION BY product_id, store_id) < max(sales_quantity) OVER (PARTITION BY product_id, store_id) AS varies
      FROM sales) WHERE i > 0 AND varies) GROUP BY ALL"""))
def _(spark, sf):
    history = sequence.train(panel_series(spark, sf), K, kind="recurrent").history
    return history.filter("epoch = 60").select("split", "n", "epoch")


@register("m26_sequence_holdout")
def _(spark, sf):
    return sequence.evaluate_holdout(panel_series(spark, sf), K)[1]


@register("m26_holdout_rows", oracle(holdout_sql(sequence.MODEL)))
def _(spark, sf):
    return sequence.evaluate_holdout(panel_series(spark, sf), K)[1].select(*K, "model", "n")


@register("m27_sequence_run")
def _(spark, sf):
    return sequence.run(panel_series(spark, sf), K)["metrics"]


# --- files and refresh ------------------------------------------------------

@register("s1_s7_csv_round_trip", oracle("SELECT * FROM sales", doubles="sales_quantity unit_price", dates="date"))
def _(spark, sf):
    path = scratch(spark)
    csv.export_csv(retail.sales(spark, sf), path)
    return csv.load_csv(spark, path, SALES_SCHEMA)


@register("s3_ingest_bundle", oracle(
    """SELECT 'sales' AS table_name, count(*) AS n FROM sales UNION ALL SELECT 'products', count(*) FROM products
    UNION ALL SELECT 'stores', count(*) FROM stores"""))
def _(spark, sf):
    base = scratch(spark)
    for name, df in retail.bundle(spark, sf).items():
        csv.export_csv(df, f"{base}/{csv.FILES[name][0]}")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
              for name, df in csv.ingest_all(spark, base).items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@register("s4_s5_stage_round_trip", oracle("SELECT * FROM sales", doubles="sales_quantity unit_price", dates="date"))
def _(spark, sf):
    base = scratch(spark)
    stages.write_stage(retail.sales(spark, sf), base, "sales", "date")
    stages.write_stage(retail.products(spark, sf), base, "products")
    return stages.load_all(spark, base, ("sales", "products"))["sales"].select(*SALES_SCHEMA.names)


@register("s6_build_missing_stage", oracle("SELECT * FROM products"))
def _(spark, sf):
    tables = stages.load_all(
        spark, scratch(spark), ("products",), lambda: {"products": retail.products(spark, sf)})
    return tables["products"].select(*PRODUCTS_SCHEMA.names)


@register("st1_incremental_refresh", oracle("SELECT * FROM daily", doubles="total_sales", dates="date"))
def _(spark, sf):
    base = scratch(spark)
    sales = retail.sales(spark, sf).withColumn("store_rank", F.dense_rank().over(
        sarimax.series_window(("date", "product_id"), "store_id")))
    # two arrivals in a source partitioned by month; the second brings late rows for dates the first one covered
    for late in (False, True):
        part = sales.filter((F.col("store_rank") > 1) == late).drop("store_rank")
        part = part.withColumn("year_month", F.date_format("date", "yyyy-MM"))
        part.hint("rebalance", "year_month").write.mode("append").partitionBy("year_month").parquet(f"{base}/sales")
        refresh.start_refresh(spark, f"{base}/sales", f"{base}/daily", f"{base}/progress").awaitTermination()
    return refresh.read_daily(spark, f"{base}/daily")
