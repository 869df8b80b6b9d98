"""Scalar expressions in which null, and nothing else, means unobserved."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def observed(x: Column) -> Column:
    """NaN and infinities as null."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def at_least(x: Column, low: float) -> Column:
    """max(x, low), null if x is: greatest() would ignore it."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def safe_log1p(x: Column) -> Column:
    return F.when(x > -1, F.log1p(x))


def future_return_label(now: Column, future: Column) -> Column:
    """1 if the later close is higher; 0 else, and if either is not positive."""
    return F.when(F.least(now, future) <= 0, 0).otherwise((future > now).cast("int"))


def above(x: Column, threshold: Column | float) -> Column:
    return (x > threshold).cast("int")


def at_or_above(x: Column, threshold: Column | float) -> Column:
    return (x >= threshold).cast("int")


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / std


def robust(x: Column, median: Column, iqr: Column) -> Column:
    return (x - median) / iqr


def log_transform(x: Column) -> Column:
    return F.log1p(F.abs(x))


def learning_rate(step: Column, warm_up: int, total: int) -> Column:
    """Factor of a schedule: linear warm-up, then a cosine down to 0."""
    done = F.least(F.greatest((step - warm_up) / float(max(1, total - warm_up)), F.lit(0.0)), F.lit(1.0))
    return F.when(step < warm_up, step / float(max(1, warm_up))).otherwise(0.5 * (1 + F.cos(done * pi)))
