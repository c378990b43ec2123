"""Measurements as CSV with a header; values with separators, quotes or line ends are quoted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_report(rows: DataFrame, path: str, files: int = 1) -> None:
    """rows are measurements, so few that one file holds them."""
    rows.coalesce(files).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
