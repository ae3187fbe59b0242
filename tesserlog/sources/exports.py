"""Tables as Parquet, and ordered extracts as one CSV file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def save(df: DataFrame, path: str) -> DataFrame:
    """Write in place of what is there and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def save_csv(df: DataFrame, path: str, order: list[str | Column], most: int | None = None) -> None:
    """The first rows in the given order, in one file with a header; arrays as text. Without ``most``, all rows in ordered files."""
    flat = [F.col(f.name).cast("string").alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in df.schema]
    rows = df.orderBy(*order)
    rows = (rows.limit(most).coalesce(1) if most else rows).select(*flat)
    rows.write.mode("overwrite").option("header", True).csv(path)
