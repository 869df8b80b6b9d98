"""Market state: bars with sparse modalities and calendar fields, known at each bar's close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FUNDING, OPEN_INTEREST, AlignmentPolicy, frequency_ms
from ..functions.time import bucket, calendar_fields
from .asof import DAY_MS, asof, asof_filled, forward_fill, running_last
from .stats import thresholds

MINUTE_MS = 60_000
#: Modalities that a contract may name but that this alignment does not take.
INACTIVE = ("agg_trades", "depth", "liquidations")


def first_column(frame: DataFrame, names: tuple[str, ...]) -> str:
    """The first of `names` that `frame` has; KeyError if none."""
    for name in names:
        if name in frame.columns:
            return name
    raise KeyError(f"none of {', '.join(names)} is in {', '.join(frame.columns)}")


def known_at(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """`timestamp` moved from a bar's opening to its close: close_time if there is one, else the opening plus the median gap of
    the key's bars (cut to whole milliseconds, one minute at least) less 1 ms."""
    if "timestamp" not in bars.columns:
        raise KeyError("bars need a timestamp")
    if "close_time" in bars.columns:
        return bars.withColumn("timestamp", F.col("close_time").cast("long"))
    gap = F.col("timestamp") - F.lag("timestamp").over(Window.partitionBy(*keys).orderBy("timestamp"))
    medians = thresholds(bars.select(*keys, gap.alias("gap")), ["gap"], list(keys))
    gaps = medians.select(*keys, F.greatest(F.coalesce(F.floor("gap_threshold"), F.lit(0)), F.lit(MINUTE_MS)).cast("long").alias("_gap"))
    return bars.join(gaps, list(keys)).withColumn("timestamp", F.col("timestamp") + F.col("_gap") - 1).drop("_gap")


def sparse(frame: DataFrame, policy: AlignmentPolicy, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """keys, timestamp and the policy's value, both made numeric; rows without a time go. KeyError if a column is missing."""
    at, value = first_column(frame, policy.time_columns), first_column(frame, policy.value_columns or (policy.name,))
    rows = frame.select(*keys, F.expr(f"try_cast(`{at}` AS DOUBLE)").cast("long").alias("timestamp"), F.expr(f"try_cast(`{value}` AS DOUBLE)").alias(policy.name))
    return rows.filter("timestamp IS NOT NULL")


def join_sparse(state: DataFrame, frames: dict[AlignmentPolicy, DataFrame | None], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """`state` with each policy's value and `<name>_stale`.

    The value is that of the last row at or before the bar's time, filled forward over bars where that row has none. It is
    stale if that row is farther back than the frequency, or if there is none. An absent frame gives nulls that are not
    stale, as does any policy but forward_fill. Columns of `state` with these names are replaced.
    """
    state = state.drop(*[c for p in frames for c in (p.name, f"{p.name}_stale") if c in state.columns])
    joined = {p.name: sparse(f, p, keys) for p, f in frames.items() if f is not None and p.policy == "forward_fill"}
    if joined:
        state = asof_filled(state, joined, list(keys))
    for policy in frames:
        name, stale = policy.name, f"{policy.name}_stale"
        if name in joined:
            age = F.col(f"{name}_age")
            state = state.withColumn(stale, age.isNull() | (age > frequency_ms(policy.frequency))).drop(f"{name}_age")
        else:
            state = state.withColumn(name, F.lit(None).cast("double")).withColumn(stale, F.lit(False))
    return state


def join_calendar(state: DataFrame, calendar: DataFrame | None = None, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """`state` with calendar fields: computed of the bar's minute, or those of a complete one-minute `calendar`."""
    minute = bucket(F.col("timestamp"), MINUTE_MS)
    if calendar is None:
        return state.withColumns(calendar_fields(minute))
    fields = [c for c in calendar.columns if c != "timestamp"]
    state = state.drop(*[c for c in fields if c in state.columns])
    return state.join(calendar.withColumnRenamed("timestamp", "_minute"), minute == F.col("_minute"), "left").drop("_minute")


def market_state(bars: DataFrame, funding: DataFrame | None = None, open_interest: DataFrame | None = None, calendar: DataFrame | None = None, keys: tuple[str, ...] = ("symbol",), policies: tuple[AlignmentPolicy, AlignmentPolicy] = (FUNDING, OPEN_INTEREST), **inactive: DataFrame) -> DataFrame:
    """Bars at their closing times with funding, open interest and calendar. Other modalities are a ValueError."""
    for name, frame in inactive.items():
        if name not in INACTIVE or frame is not None:
            raise ValueError(f"modality {name} is not active")
    state = known_at(bars, keys)
    state = join_sparse(state, {policies[0]: funding, policies[1]: open_interest}, keys)
    return join_calendar(state, calendar, keys)


def between(frame: DataFrame, start_ms: int | None = None, end_ms: int | None = None, column: str = "timestamp") -> DataFrame:
    """Rows of a closed range, either end of which may be open; the predicate reaches the Parquet scan."""
    if start_ms is not None:
        frame = frame.filter(F.col(column) >= start_ms)
    return frame if end_ms is None else frame.filter(F.col(column) <= end_ms)


def lookback(start_ms: int | None, by_ms: int = 8 * 3_600_000) -> int | None:
    """From where a sparse modality is read, so that the first bar has something to look back to."""
    return None if start_ms is None else max(0, start_ms - by_ms)


def coverage(state: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """For each key: rows, and rows with funding and with open interest."""
    return state.groupBy(*keys).agg(F.count("*").alias("total_rows"), F.count("funding_rate").alias("funding_rows"), F.count("open_interest").alias("oi_rows"))


def trades_to_minute(trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Trades (timestamp, price, qty, is_buyer_maker) as one row for each key and minute that has any."""
    taker_buys = ~F.col("is_buyer_maker")

    def when(condition: Column, value) -> Column:
        return F.sum(F.when(condition, value).otherwise(0))

    return trades.groupBy(*keys, bucket(F.col("timestamp"), MINUTE_MS).alias("timestamp")).agg(
        F.count("*").alias("trade_count"), F.sum("qty").alias("base_volume"), F.sum(F.col("price") * F.col("qty")).alias("quote_volume"),
        when(taker_buys, F.col("qty")).alias("taker_buy_volume"), when(~taker_buys, F.col("qty")).alias("taker_sell_volume"),
        when(taker_buys, 1).alias("taker_buy_count"), when(~taker_buys, 1).alias("taker_sell_count"),
    )


def on_grid(rows: DataFrame, grid: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """`grid` (keys, timestamp) with the columns of `rows`, zeros where it has no row."""
    values = [c for c in rows.columns if c not in (*keys, "timestamp")]
    return grid.join(rows, [*keys, "timestamp"], "left").fillna(0, values)


def snapshot_before_close(state: DataFrame, depth: DataFrame, values: list[str], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The last snapshot strictly before each bar's time; null if there is none."""
    return asof(state, depth, list(keys), values, strict=True).drop("match_timestamp")


__all__ = ["DAY_MS", "running_last", "asof", "forward_fill", "market_state", "known_at", "sparse", "join_sparse", "join_calendar", "between", "lookback", "coverage", "trades_to_minute", "on_grid", "snapshot_before_close", "first_column"]
