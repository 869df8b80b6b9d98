"""Fixed-length windows over ordered rows, their statistics and labels.

Windows start at every `stride`-th row of a key's series, are never re-based after a gap, and are left out if a gap
within is too long. Valid starts come from frame aggregates alone; then each row goes to the windows that hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import WindowSpec
from ..functions.numbers import future_return_label
from .asof import DAY_MS, asof, first_if_null, lagged, time_slot
from .ranks import ranged

MINUTE_MS = 60_000


def check_increasing(frame: DataFrame, keys: tuple[str, ...] = ("symbol",), slot_ms: int = DAY_MS) -> None:
    """Raises ValueError, with the first ten such times, if times of a key do not strictly increase in the order of `timestamp`: that
    is, if any repeats or is null. Lags run in slots of time, so a key's rows are as many tasks as it has slots."""
    rows = frame.select(*keys, "timestamp").withColumn("_slot", time_slot(F.col("timestamp"), slot_ms))
    rows = lagged(rows, list(keys), "_slot", [first_if_null(F.col("timestamp"))], {"_last": F.col("timestamp")})
    bad = rows.filter("timestamp - _last <= 0 OR timestamp IS NULL").orderBy(*keys, "timestamp").limit(10).collect()
    if bad:
        raise ValueError("non-positive delta at " + ", ".join(f"{tuple(r[k] for k in keys)}:{r['timestamp']}" for r in bad))


def window_starts(frame: DataFrame, spec: WindowSpec = WindowSpec(), keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """keys, start_index, start_ts, end_ts, span_ms, max_gap_ms, min_gap_ms, contiguous of every accepted window."""
    order = Window.partitionBy(*keys).orderBy("timestamp")
    ahead, inside = order.rowsBetween(0, spec.length - 1), order.rowsBetween(0, spec.length - 2)
    rows = frame.select(*keys, "timestamp").withColumn("gap", F.lead("timestamp").over(order) - F.col("timestamp"))
    none = F.lit(None).cast("long")
    rows = rows.select(
        *keys, (F.row_number().over(order) - 1).cast("long").alias("start_index"), F.col("timestamp").alias("start_ts"),
        F.last("timestamp").over(ahead).alias("end_ts"), F.count("*").over(ahead).alias("n"),
        (F.max("gap").over(inside) if spec.length > 1 else none).alias("max_gap_ms"), (F.min("gap").over(inside) if spec.length > 1 else none).alias("min_gap_ms"),
    )
    rows = rows.filter((F.col("n") == spec.length) & (F.col("start_index") % spec.stride == 0) & (F.coalesce("max_gap_ms", F.lit(0)) <= spec.max_gap_ms))
    gap = F.coalesce("max_gap_ms", F.lit(0))
    return rows.select(*keys, "start_index", "start_ts", "end_ts", (F.col("end_ts") - F.col("start_ts")).alias("span_ms"), gap.alias("max_gap_ms"), F.coalesce("min_gap_ms", F.lit(0)).alias("min_gap_ms"), (gap <= MINUTE_MS).alias("contiguous"))


def rejected(frame: DataFrame, spec: WindowSpec = WindowSpec(), keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """For each key: full windows at stride places, and those of them that a gap rejects."""
    every = window_starts(frame, WindowSpec(spec.length, spec.stride, (1 << 62)), keys)
    return every.groupBy(*keys).agg(F.count("*").alias("candidates"), F.sum((F.col("max_gap_ms") > spec.max_gap_ms).cast("long")).alias("rejected"))


def position_mask(times: Column, feature_mask: Column) -> Column:
    """For each place: any feature observed, and the gap to the next at most twice the median gap; the last place's is not asked."""
    gaps = F.zip_with(F.slice(times, 2, F.size(times) - 1), F.slice(times, 1, F.size(times) - 1), lambda b, a: b - a)
    ranked, n = F.array_sort(gaps), F.size(gaps)
    middle = F.floor((F.element_at(ranked, F.floor((n + 1) / 2).cast("int")) + F.element_at(ranked, F.floor(n / 2 + 1).cast("int"))) / 2)
    wide = F.concat(F.transform(gaps, lambda g: g > 2 * middle), F.array(F.lit(False)))
    seen = F.transform(feature_mask, lambda row: F.exists(row, lambda x: x))
    return F.when(F.size(times) > 1, F.zip_with(seen, wide, lambda s, w: s & ~w)).otherwise(seen)


def create_windows(features: DataFrame, spec: WindowSpec = WindowSpec(), keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row for each window: keys, features, feature_mask, timestamps, mask and metadata (see window_starts)."""
    starts = window_starts(features, spec, keys)
    # A row is in the windows that start at stride places up to length - 1 rows before it: it goes to each of them.
    place = (F.row_number().over(Window.partitionBy(*keys).orderBy("timestamp")) - 1).cast("long")
    rows = features.select(*keys, place.alias("_i"), F.struct("timestamp", "features", "feature_mask").alias("_row"))
    least = F.greatest(F.ceil((F.col("_i") - spec.length + 1) / spec.stride), F.lit(0))
    dealt = rows.filter(least <= F.floor(F.col("_i") / spec.stride)).select(*keys, "_row", F.explode(F.sequence(least, F.floor(F.col("_i") / spec.stride))).alias("_w"))
    dealt = dealt.withColumn("start_index", F.col("_w") * spec.stride).groupBy(*keys, "start_index").agg(F.array_sort(F.collect_list("_row")).alias("rows"))
    found = starts.join(dealt, [*keys, "start_index"])
    meta = F.struct("start_index", "start_ts", "end_ts", "span_ms", "max_gap_ms", "min_gap_ms", "contiguous")
    return found.select(
        *keys, F.col("rows.features").alias("features"), F.col("rows.feature_mask").alias("feature_mask"), F.col("rows.timestamp").alias("timestamps"),
        position_mask(F.col("rows.timestamp"), F.col("rows.feature_mask")).alias("mask"), meta.alias("metadata"),
    )


def items(windows: DataFrame, partitions: bool = True):
    """Windows one by one as dicts, for a loader: a partition at a time comes to the driver."""
    for row in windows.toLocalIterator(prefetchPartitions=partitions):
        yield row.asDict(recursive=True)


def window_stats(bars: DataFrame, spec: WindowSpec = WindowSpec(), keys: tuple[str, ...] = ("symbol",), floor: float = 1e-12) -> DataFrame:
    """keys, start_ts, end_ts and statistics of each accepted window of bars (timestamp, high, low, close, volume): volatility
    (population), range, volume, last_return, abs_return_mean, up_ratio, max_abs_return, return_skew (population; the cubed
    deviation is `floor` at least). Frames do it: no arrays are made."""
    order = Window.partitionBy(*keys).orderBy("timestamp")
    all_rows, steps = order.rowsBetween(0, spec.length - 1), order.rowsBetween(1, spec.length - 1)
    close = F.greatest(F.col("close"), F.lit(floor))
    rows = bars.withColumn("lr", F.log(close) - F.lag(F.log(close)).over(order)).withColumn("rel", (F.col("high") - F.col("low")) / close)
    m1, m2, m3 = (F.avg(F.pow("lr", F.lit(float(p)))).over(steps) for p in (1, 2, 3))
    rows = rows.select(
        *keys, F.col("timestamp").alias("start_ts"), F.stddev_pop("lr").over(steps).alias("volatility"), F.avg("rel").over(all_rows).alias("range"), F.avg("volume").over(all_rows).alias("volume"),
        F.last("lr").over(steps).alias("last_return"), F.avg(F.abs("lr")).over(steps).alias("abs_return_mean"), F.avg((F.col("lr") > 0).cast("double")).over(steps).alias("up_ratio"),
        F.max(F.abs("lr")).over(steps).alias("max_abs_return"), (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1).alias("third"),
    )
    if spec.length < 2:
        rows = rows.withColumns({c: F.lit(0.0) for c in ("volatility", "range", "volume", "last_return", "abs_return_mean", "max_abs_return", "third")}).withColumn("up_ratio", F.lit(0.5))
    rows = rows.withColumn("return_skew", F.col("third") / F.greatest(F.pow("volatility", F.lit(3.0)), F.lit(1e-12))).drop("third")
    return window_starts(bars, spec, keys).select(*keys, "start_ts", "end_ts").join(rows, [*keys, "start_ts"])


def handcrafted_vector() -> Column:
    """The statistics as a fixed vector of eight."""
    return F.array(F.col("volatility"), F.col("range"), F.log1p("volume"), F.col("abs_return_mean"), F.col("last_return"), F.col("up_ratio"), F.col("max_abs_return"), F.col("return_skew"))


def future_labels(windows: DataFrame, closes: DataFrame, horizon_ms: int, budget_end_ms: int | None = None, keys: tuple[str, ...] = ("symbol",), positive_only: bool = True) -> DataFrame:
    """`windows` (keys, end_ts) with close_now (last close at or before end_ts), close_future (first at or after end_ts +
    horizon) and label. Windows that lack either, or, with a budget, look past it, go; so do those with a close that is not
    positive, if asked."""
    if budget_end_ms is not None:
        windows = windows.filter(F.col("end_ts") + horizon_ms <= budget_end_ms)
    now = asof(windows.withColumn("timestamp", F.col("end_ts")), closes.select(*keys, "timestamp", F.col("close").alias("close_now")), list(keys), ["close_now"]).drop("match_timestamp")
    later = asof(now.withColumn("timestamp", F.col("end_ts") + horizon_ms), closes.select(*keys, "timestamp", F.col("close").alias("close_future")), list(keys), ["close_future"], direction="forward")
    found = later.drop("match_timestamp", "timestamp").filter("close_now IS NOT NULL AND close_future IS NOT NULL")
    if positive_only:
        found = found.filter("close_now > 0 AND close_future > 0")
    return found.withColumn("label", future_return_label(F.col("close_now"), F.col("close_future")))


def split(windows: DataFrame, which: str, train_end_ms: int, symbols: list[str] | None = None, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """train: ends before train_end; test: starts at or after it; validation: any time. Symbols restrict each."""
    if symbols is not None:
        windows = windows.filter(F.col("symbol").isin(symbols))
    if which == "train":
        return windows.filter(F.col(end) < train_end_ms)
    return windows.filter(F.col(start) >= train_end_ms) if which == "test" else windows


def shared_symbols(a: DataFrame, b: DataFrame) -> DataFrame:
    """Symbols of both; none if splits are disjoint."""
    return a.select("symbol").intersect(b.select("symbol"))


def with_next(frame: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """`frame` and next_<column>: those of the following row in the order of all rows, null for the last.

    Rows are dealt by range; the last row of a slot takes the first row of the next slot that has any, found on one row for
    each slot, so no task sorts all rows.
    """
    rows = ranged(frame, *order)
    following = F.struct(*columns)
    heads = rows.groupBy("_slot").agg(F.min_by(following, F.struct(*order)).alias("_head"))
    heads = heads.select("_slot", F.lead("_head").over(Window.orderBy("_slot")).alias("_head"))  # a row for each partition
    inside = rows.withColumn("_next", F.lead(following).over(Window.partitionBy("_slot").orderBy(*order)))
    found = inside.join(heads, "_slot").withColumn("_next", F.coalesce("_next", "_head"))
    return found.select(*frame.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])


def gap_segments(frame: DataFrame, max_gap_ms: int, keys: tuple[str, ...] = ("symbol",), slot_ms: int = DAY_MS) -> DataFrame:
    """keys, segment, start_ts, end_ts, n_rows: runs of rows without a longer gap. Gaps are counted up within slots of time, and
    over the slots' sums, so a key's rows are as many tasks as it has slots."""
    keys = list(keys)
    rows = frame.select(*keys, "timestamp").withColumn("_slot", time_slot(F.col("timestamp"), slot_ms))
    rows = lagged(rows, keys, "_slot", [first_if_null(F.col("timestamp"))], {"_last": F.col("timestamp")})
    rows = rows.withColumn("cut", F.coalesce(((F.col("timestamp") - F.col("_last")) > max_gap_ms).cast("long"), F.lit(0)))
    cuts = rows.groupBy(*keys, "_slot").agg(F.sum("cut").alias("cuts"))
    ahead = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.select(*keys, "_slot", F.coalesce(F.sum("cuts").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*keys, "_slot").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_inside", F.sum("cut").over(inside)).join(cuts, [*keys, "_slot"])
    rows = rows.withColumn("segment", F.col("_ahead") + F.col("_inside"))
    return rows.groupBy(*keys, "segment").agg(F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"), F.count("*").alias("n_rows"))


def max_position(windows: DataFrame) -> DataFrame:
    """One row: the largest number of minute positions that any window needs."""
    return windows.agg((F.max(F.floor((F.array_max("timestamps") - F.element_at("timestamps", 1)) / MINUTE_MS)) + 1).alias("max_position"))
