"""Generated one-minute calendars."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import calendar_fields

MINUTE_MS = 60_000


def calendar(spark: SparkSession, year: int) -> DataFrame:
    """timestamp and calendar fields of each minute of a year in UTC."""
    start, end = (int(datetime(y, 1, 1, tzinfo=UTC).timestamp() * 1000) for y in (year, year + 1))
    return grid(spark, start, end - MINUTE_MS).withColumns(calendar_fields(F.col("timestamp")))


def grid(spark: SparkSession, start_ms: int, end_ms: int, step_ms: int = MINUTE_MS) -> DataFrame:
    """timestamp from start to end, both included."""
    return spark.range(start_ms, end_ms + 1, step_ms).select(F.col("id").alias("timestamp"))
