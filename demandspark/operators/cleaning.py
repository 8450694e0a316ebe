"""Cleaning: date casts, missing cells, duplicates, derived amount."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandspark.functions.calendar import to_date_safe


def _missing(field: T.StructField) -> Column:
    col = F.col(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def cast_dates(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: to_date_safe(F.col(c)) for c in columns})


def missing_counts(df: DataFrame) -> DataFrame:
    """One row: missing cells per column (``<name>_missing``) and in total."""
    per_column = {f.name: F.count(F.when(_missing(f), 1)) for f in df.schema.fields}
    counts = df.agg(*[c.alias(f"{name}_missing") for name, c in per_column.items()])
    total = sum((F.col(f"{name}_missing") for name in per_column), F.lit(0).cast("long"))
    return counts.withColumn("missing_total", total)


def complete_cases(df: DataFrame) -> DataFrame:
    """Rows without NULL or NaN in any column."""
    return df.na.drop("any")


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: surplus copies of full rows.

    Copies are combined map-side first, so a row repeated a billion times
    reaches the shuffle once per task.
    """
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("copies"))
    return copies.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"))


def with_sales_amount(df: DataFrame) -> DataFrame:
    return df.withColumn("sales_amount", F.col("sales_quantity") * F.col("unit_price"))


def clean_sales(df: DataFrame) -> DataFrame:
    return with_sales_amount(complete_cases(cast_dates(df, "date")).distinct())


def clean_products(df: DataFrame) -> DataFrame:
    return complete_cases(df)


def clean_stores(df: DataFrame) -> DataFrame:
    return complete_cases(cast_dates(df, "opening_date"))


def counted_rows(df: DataFrame, dedupe: bool) -> DataFrame:
    """Rows with their missing cells (``_missing``) and copies (``_copies``), each distinct row once if ``dedupe``.

    Both what is clean and how much was not follow from it, so a table is aggregated once.
    """
    missing = sum((_missing(f).cast("int") for f in df.schema.fields), F.lit(0))
    marked = df.withColumn("_missing", missing)
    if dedupe:
        return marked.groupBy(*df.columns, "_missing").agg(F.count("*").alias("_copies"))
    return marked.withColumn("_copies", F.lit(1).cast("long"))


def clean_rows(counted: DataFrame) -> DataFrame:
    """The complete ones of :func:`counted_rows`."""
    return counted.filter("_missing = 0").drop("_missing", "_copies")


def quality_of(counted: DataFrame, table: str) -> DataFrame:
    """One row: rows in, missing cells, incomplete rows, duplicates, rows out."""
    copies, whole = F.col("_copies"), F.col("_missing") == 0

    def total(col: Column) -> Column:
        return F.coalesce(F.sum(col), F.lit(0)).cast("long")

    surplus = F.when(whole, copies - 1).otherwise(0)
    return counted.agg(
        total(copies).alias("rows_in"),
        total(copies * F.col("_missing")).alias("missing_cells"),
        total(F.when(whole, 0).otherwise(copies)).alias("incomplete_rows"),
        total(surplus).alias("duplicate_rows"),
        total(F.when(whole, copies).otherwise(0) - surplus).alias("rows_out"),
    ).select(F.lit(table).alias("table_name"), "*")


def quality_row(df: DataFrame, table: str, dedupe: bool) -> DataFrame:
    """One row of :func:`quality_of` for a raw table: one shuffle of it."""
    return quality_of(counted_rows(df, dedupe), table)


def quality_report(raw: Mapping[str, DataFrame]) -> DataFrame:
    return (
        quality_row(cast_dates(raw["sales"], "date"), "sales", True)
        .unionByName(quality_row(raw["products"], "products", False))
        .unionByName(quality_row(cast_dates(raw["stores"], "opening_date"), "stores", False))
    )


def clean_all(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        "sales": clean_sales(raw["sales"]),
        "products": clean_products(raw["products"]),
        "stores": clean_stores(raw["stores"]),
    }
