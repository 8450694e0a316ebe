"""CSV scans with declared schemas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from demandspark.schema import PRODUCTS_SCHEMA, SALES_SCHEMA, STORES_SCHEMA

FILES = {
    "sales": ("sample_retail_sales.csv", SALES_SCHEMA),
    "products": ("product_info.csv", PRODUCTS_SCHEMA),
    "stores": ("store_info.csv", STORES_SCHEMA),
}


def load_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    mode: str = "PERMISSIVE",
) -> DataFrame:
    """Read one CSV file or folder; a missing path raises here, not later.

    Cells are trimmed and both "" and "NA" are NULL. Without a schema the
    column types are inferred (an extra pass over the file).
    """
    reader = (
        spark.read.option("header", True)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("nullValue", "NA")
        .option("mode", mode)
    )
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def ingest_all(
    spark: SparkSession,
    base_path: str,
    files: Mapping[str, tuple[str, StructType]] = FILES,
) -> dict[str, DataFrame]:
    """The sales / products / stores bundle."""
    return {
        table: load_csv(spark, f"{base_path.rstrip('/')}/{name}", schema)
        for table, (name, schema) in files.items()
    }


def export_csv(df: DataFrame, path: str) -> None:
    """Report export; one folder of part files with a header each."""
    df.write.mode("overwrite").option("header", True).csv(path)
