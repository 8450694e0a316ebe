"""Query registry, shared SQL prefix and shared Spark inputs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandspark.operators import cleaning
from demandspark.operators.aggregates import daily_total
from demandspark.sources import retail

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6
# One exact division on both sides: bit-equal as it is, and full of rounding ties.
EXACT = {"unit_price"}

# The test tables lie in 1995-2001, so the holiday calendar is given for those years.
YEARS = range(1995, 2002)
HOLIDAYS = [date(y, m, d) for y in YEARS for m, d in ((1, 1), (7, 4), (11, 11), (12, 25))]
EVENTS = [date(y, m, d) for y in YEARS for m, d in ((1, 15), (2, 14), (11, 27))]


def sql_dates(dates) -> str:
    return "(" + ", ".join(f"DATE '{x.isoformat()}'" for x in dates) + ")"


def comparable(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded (and -0.0 made 0.0), dates as ISO text: equal on both sides."""
    columns = []
    for field in df.schema.fields:
        col = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType) and field.name not in EXACT:
            col = F.round(col, digits) + F.lit(0.0)
        elif isinstance(field.dataType, T.DateType):
            col = col.cast("string")
        columns.append(col.alias(field.name))
    return df.select(*columns)


CTE = """
WITH sales AS (
  SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS product_id, r_name AS store_id,
         SUM(l_quantity) AS sales_quantity,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / SUM(l_quantity) AS unit_price
  FROM lineitem JOIN part ON l_partkey = p_partkey
       JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
  GROUP BY CAST(l_shipdate AS DATE), p_brand, r_name
),
products AS (
  SELECT p_brand AS product_id, MIN(p_name) AS product_name, MIN(p_type) AS category,
         'Supplier ' || substr(p_brand, 7) AS supplier,
         CAST(7 + 7 * (CAST(substr(p_brand, 7) AS INT) % 3) AS INT) AS lead_time_days,
         CAST(25 * (1 + CAST(substr(p_brand, 7) AS INT) % 4) AS INT) AS min_order_quantity
  FROM part GROUP BY p_brand
),
stores AS (
  SELECT r_name AS store_id, 'Store ' || r_name AS store_name, r_name AS location,
         CAST(3500 + 500 * r_regionkey AS INT) AS size_sqft,
         CAST('1994-01-01' AS DATE) AS opening_date
  FROM region
),
daily AS (
  SELECT date, SUM(sales_quantity) AS total_sales FROM sales GROUP BY date
)"""

# Dirt for the cleaning operators, added alike on both sides: NULL quantities,
# exact copies, and unreadable date text.
DIRTY = CTE + """,
raw_sales AS (
  SELECT CASE WHEN day(date) = 31 AND store_id = 'ASIA' THEN 'not a date'
              ELSE strftime(date, '%Y-%m-%d') END AS date,
         product_id, store_id,
         CASE WHEN product_id = 'Brand#3' AND day(date) <= 3 THEN NULL
              ELSE sales_quantity END AS sales_quantity,
         unit_price
  FROM sales
  UNION ALL
  SELECT strftime(date, '%Y-%m-%d'), product_id, store_id, sales_quantity, unit_price
  FROM sales WHERE day(date) = 15
),
raw_products AS (
  SELECT product_id, product_name, category, supplier,
         CASE WHEN product_id = 'Brand#7' THEN NULL ELSE lead_time_days END AS lead_time_days,
         min_order_quantity
  FROM products
),
raw_stores AS (
  SELECT store_id, store_name, location, size_sqft,
         CASE WHEN store_id = 'EUROPE' THEN 'unknown'
              ELSE strftime(opening_date, '%Y-%m-%d') END AS opening_date
  FROM stores
)"""


def oracle(
    select: str, cte: str = CTE, extra: str = "", doubles: str = "", dates: str = "",
    digits: int = DIGITS,
) -> str:
    """``select`` after the CTEs, rounded and formatted as ``comparable`` does."""
    rules = [f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split() if c not in EXACT]
    rules += [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates.split()]
    replace = f" REPLACE ({', '.join(rules)})" if rules else ""
    more = ",\n" + extra.strip() if extra else ""
    return f"{cte.strip()}{more}\nSELECT *{replace} FROM ({select.strip()})"


def register(name: str, sql: str | None = None, digits: int = DIGITS):
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(fn(spark, sf_dir), digits)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def raw_bundle(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The retail tables with the same dirt as ``DIRTY``."""
    tables = retail.bundle(spark, sf_dir)
    text = F.date_format("date", "yyyy-MM-dd")
    sales = tables["sales"]
    dirty = sales.select(
        F.when((F.dayofmonth("date") == 31) & (F.col("store_id") == "ASIA"), "not a date")
        .otherwise(text)
        .alias("date"),
        "product_id",
        "store_id",
        F.when(
            ~((F.col("product_id") == "Brand#3") & (F.dayofmonth("date") <= 3)),
            F.col("sales_quantity"),
        ).alias("sales_quantity"),
        "unit_price",
    )
    copies = sales.filter(F.dayofmonth("date") == 15).withColumn("date", text)
    products = tables["products"].withColumn(
        "lead_time_days", F.when(F.col("product_id") != "Brand#7", F.col("lead_time_days"))
    )
    stores = tables["stores"].withColumn(
        "opening_date",
        F.when(F.col("store_id") == "EUROPE", "unknown").otherwise(
            F.date_format("opening_date", "yyyy-MM-dd")
        ),
    )
    return {"sales": dirty.unionByName(copies), "products": products, "stores": stores}


def cleaned_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.with_sales_amount(retail.sales(spark, sf_dir))


def total_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_total(retail.sales(spark, sf_dir))


def panel_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, store_id, date, total_sales): 125 series."""
    return retail.sales(spark, sf_dir).select(
        "product_id", "store_id", "date", F.col("sales_quantity").alias("total_sales")
    )
