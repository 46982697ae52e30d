"""Time spines and inline dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def time_spine(spark: SparkSession, start: str, end: str, step: str = "15 minutes", column: str = "slot_ts") -> DataFrame:
    """Every step from start to end, both included."""
    ends = (F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    return spark.range(1).select(F.explode(F.sequence(*ends, F.expr(f"interval {step}"))).alias(column))


def seed_if_empty(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """The given rows when the table is empty, otherwise the table as it is."""
    return df.sparkSession.createDataFrame(rows, df.schema) if df.isEmpty() else df


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)
