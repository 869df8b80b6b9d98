"""Time as columns: epoch milliseconds, buckets and calendar fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import UNITS


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970, cut, not rounded; a timestamp without zone is taken as UTC."""
    return F.unix_millis(ts.cast("timestamp"))


def as_timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def bucket(ms: Column, width_ms: int) -> Column:
    """The start of the bucket that holds `ms`; right for times before 1970 too."""
    return ms - F.pmod(ms, F.lit(width_ms))


def calendar_fields(ms: Column) -> dict[str, Column]:
    """minute_of_day, hour, day_of_week (Monday 0), day_of_month, month, quarter, year, is_weekend."""
    ts = as_timestamp(ms)
    day = F.weekday(ts)
    return {
        "minute_of_day": (F.hour(ts) * 60 + F.minute(ts)).cast("int"),
        "hour": F.hour(ts).cast("int"),
        "day_of_week": day.cast("int"),
        "day_of_month": F.dayofmonth(ts).cast("int"),
        "month": F.month(ts).cast("int"),
        "quarter": F.quarter(ts).cast("int"),
        "year": F.year(ts).cast("int"),
        "is_weekend": (day >= 5).cast("tinyint"),
    }


def frequency_ms(text: Column) -> Column:
    """As config.frequency_ms, for a column of frequencies."""
    text = F.trim(text)
    unit = F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v))])
    number = F.regexp_extract(text, r"^(\d+)\s*[smhd]$", 1).try_cast("long")
    return F.coalesce(number * unit[F.regexp_extract(text, r"^\d+\s*([smhd])$", 1)], F.lit(0))
