"""Sales, products and stores derived from the order-line star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def store_of_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = _table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("store_id"))
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, product_id, store_id, sales_quantity, unit_price), one row per key.

    No join side is hinted: Catalyst broadcasts part and supplier while their
    measured size allows and otherwise sort-merges, where the adaptive skew
    join splits a hot part or supplier. The sums are combined map-side, so a
    hot (day, product, store) group costs one row per task in the shuffle.
    """
    lines = _table(spark, sf_dir, "lineitem").select(
        "l_partkey",
        "l_suppkey",
        F.to_date("l_shipdate").alias("date"),
        "l_quantity",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
    )
    part = _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("product_id")
    )
    return (
        lines.join(part, "l_partkey")
        .join(store_of_supplier(spark, sf_dir), "l_suppkey")
        .groupBy("date", "product_id", "store_id")
        .agg(F.sum("l_quantity").alias("sales_quantity"), F.sum("price").alias("revenue"))
        .select(
            "date",
            "product_id",
            "store_id",
            "sales_quantity",
            (F.col("revenue").cast("double") / F.col("sales_quantity")).alias("unit_price"),
        )
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.expr("CAST(substr(product_id, 7) AS INT)")
    return (
        _table(spark, sf_dir, "part")
        .groupBy(F.col("p_brand").alias("product_id"))
        .agg(F.min("p_name").alias("product_name"), F.min("p_type").alias("category"))
        .select(
            "product_id",
            "product_name",
            "category",
            F.concat(F.lit("Supplier "), F.expr("substr(product_id, 7)")).alias("supplier"),
            (7 + 7 * (number % 3)).cast("int").alias("lead_time_days"),
            (25 * (1 + number % 4)).cast("int").alias("min_order_quantity"),
        )
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "region").select(
        F.col("r_name").alias("store_id"),
        F.concat(F.lit("Store "), F.col("r_name")).alias("store_name"),
        F.col("r_name").alias("location"),
        (3500 + 500 * F.col("r_regionkey")).cast("int").alias("size_sqft"),
        F.to_date(F.lit("1994-01-01")).alias("opening_date"),
    )


def bundle(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "sales": sales(spark, sf_dir),
        "products": products(spark, sf_dir),
        "stores": stores(spark, sf_dir),
    }
