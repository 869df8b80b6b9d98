"""Bars: open-high-low-close-volume aggregation into buckets of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import INTERVAL_MINUTES
from ..functions.time import bucket

#: Columns that are summed if present.
SUMMED = ("volume", "quote_volume", "count", "taker_buy_volume", "taker_buy_quote_volume")


def interval_ms(interval: str) -> int:
    if interval not in INTERVAL_MINUTES:
        raise ValueError(f"unknown interval {interval!r}; known are {', '.join(INTERVAL_MINUTES)}")
    return INTERVAL_MINUTES[interval] * 60_000


def bars(ticks: DataFrame, width_ms: int, keys: tuple[str, ...] = ("symbol",), price: str = "price", qty: str = "qty", tie: str = "event_id") -> DataFrame:
    """Bars of ticks (keys, timestamp, price, qty). Of ticks at one time the smaller `tie`, a whole number, comes first.

    One hash aggregation with partial sums before its only shuffle. Time within the bucket and tie are one decimal, as hash
    aggregation updates numbers in place, where a struct would have all ticks sorted first.
    """
    at = bucket(F.col("timestamp"), width_ms)
    order = (F.col("timestamp") - at).cast("decimal(10,0)") * F.lit(str(2**64)).cast("decimal(20,0)") + F.col(tie).cast("decimal(20,0)")
    rows = ticks.groupBy(*keys, at.alias("timestamp")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.sum(qty).alias("volume"), F.count("*").alias("constituent_count"),
    )
    return rows.withColumn("close_time", F.col("timestamp") + width_ms - 1)


def resample(frame: DataFrame, interval: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Coarser bars of bars. Unknown intervals are a ValueError; columns to sum that are absent are left out.

    constituent_count counts source bars; `complete` says that there are as many as one-minute bars make the interval, and
    `status` is RESAMPLED or RESAMPLED_INCOMPLETE accordingly. Empty input gives no rows.
    """
    width = interval_ms(interval)
    sums = [F.sum(c).alias(c) for c in SUMMED if c in frame.columns]
    rows = frame.groupBy(*keys, bucket(F.col("timestamp"), width).alias("_bucket")).agg(
        F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"),
        *sums, F.count("*").alias("constituent_count"),
    )
    rows = rows.withColumnRenamed("_bucket", "timestamp").withColumn("close_time", F.col("timestamp") + width - 1)
    return rows.withColumn("complete", is_complete(interval)).withColumn("status", F.when(F.col("complete"), "RESAMPLED").otherwise("RESAMPLED_INCOMPLETE"))


def is_complete(interval: str, count: str = "constituent_count") -> Column:
    return F.col(count) >= INTERVAL_MINUTES[interval]


def verify_resample(fine: DataFrame, stored: DataFrame, interval: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row: matched buckets, and the summed differences of each column between `stored` and bars made anew of `fine`."""
    again = resample(fine, interval, keys).alias("a")
    columns = [c for c in ("open", "high", "low", "close", "volume") if c in stored.columns and c in again.columns]
    both = again.join(stored.alias("b"), [*keys, "timestamp"], "inner")
    return both.agg(F.count("*").alias("matched"), *[F.sum(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))).alias(f"{c}_diff") for c in columns])
