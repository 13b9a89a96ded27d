"""What tables hold: column lists, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def column_lists(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, columns): each table's columns in order."""
    return spark.createDataFrame([(name, ",".join(df.columns)) for name, df in tables.items()], "table_name string, columns string")
