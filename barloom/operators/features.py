"""Feature columns with their observed flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CALENDAR_FIELDS, FEATURE_ORDER, RETURN_FEATURES
from ..functions.numbers import at_least, observed, safe_log, safe_log1p

#: Modalities whose stale values stay in the features but are not observed.
STALE = ("funding_rate", "open_interest")


def _pack(frame: DataFrame, values: dict[str, Column], order: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """keys, timestamp, features (array<float>, null as 0) and feature_mask (array<boolean>)."""
    flags = []
    for name in order:
        flag = values[name].isNotNull()
        stale = f"{name}_stale"
        if name in STALE and stale in frame.columns:
            flag = flag & ~F.coalesce(F.col(stale), F.lit(False))
        flags.append(flag)
    features = F.array(*[F.coalesce(values[name], F.lit(0.0)).cast("float") for name in order])
    return frame.select(*keys, "timestamp", features.alias("features"), F.array(*flags).alias("feature_mask"))


def _column(frame: DataFrame, name: str) -> Column:
    return observed(F.col(name)) if name in frame.columns else F.lit(None).cast("double")


def raw_features(state: DataFrame, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = FEATURE_ORDER, dimension: int | None = None) -> DataFrame:
    """Columns as they are, in a fixed order; absent ones are unobserved, and so are NaN and infinities.

    A `dimension` that is not the order's length is a ValueError.
    """
    if dimension is not None and dimension != len(order):
        raise ValueError(f"{len(order)} features in order, {dimension} declared")
    return _pack(state, {name: _column(state, name) for name in order}, order, keys)


def return_columns(state: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> dict[str, Column]:
    """The stationary features as expressions: log_return, hl_range, oc_body, log_volume, volume_change, funding_rate,
    open_interest (log1p), calendar. Logarithms of what has none, and divisions by zero, are null."""
    before = Window.partitionBy(*keys).orderBy("timestamp")
    close, volume = _column(state, "close"), safe_log1p(at_least(_column(state, "volume"), 0.0))
    found = {
        "log_return": safe_log(F.try_divide(close, F.lag(close).over(before))),
        "hl_range": F.try_divide(_column(state, "high") - _column(state, "low"), close),
        "oc_body": F.try_divide(close - _column(state, "open"), close),
        "log_volume": volume,
        "volume_change": volume - F.lag(volume).over(before),
        "funding_rate": _column(state, "funding_rate"),
        "open_interest": safe_log1p(at_least(_column(state, "open_interest"), 0.0)),
    }
    return found | {c: _column(state, c) for c in CALENDAR_FIELDS}


def return_features(state: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return _pack(state, return_columns(state, keys), RETURN_FEATURES, keys)


def build_features(state: DataFrame, style: str = "raw", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """style: raw (levels) or returns (stationary)."""
    return return_features(state, keys) if style == "returns" else raw_features(state, keys)


def mask_rate(features: DataFrame, order: tuple[str, ...] = FEATURE_ORDER) -> DataFrame:
    """(feature, observed, total): how often each feature is observed."""
    named = features.select(F.posexplode("feature_mask").alias("at", "seen"))
    names = F.array(*[F.lit(n) for n in order])
    return named.groupBy(F.element_at(names, F.col("at") + 1).alias("feature")).agg(F.sum(F.col("seen").cast("long")).alias("observed"), F.count("*").alias("total"))
