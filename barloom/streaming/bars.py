"""Structured Streaming forms of bars, as-of alignment, windows and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import WindowSpec


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str | None = "10 minutes", key: str = "symbol", tie: str = "event_id") -> DataFrame:
    """Bars of a stream of ticks (symbol, ts, price, qty, tie). With a watermark a bar is given once, when it can no longer
    change, that is, when it is known; without one (complete mode) all bars are given anew each time."""
    if late:
        ticks = ticks.withWatermark("ts", late)
    order = F.struct("ts", tie)
    rows = ticks.groupBy(F.window("ts", width).alias("w"), key).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("qty").alias("volume"), F.count("*").alias("constituent_count"),
    )
    return rows.select(key, F.unix_millis("w.start").alias("timestamp"), "open", "high", "low", "close", "volume", "constituent_count", (F.unix_millis("w.end") - 1).alias("close_time"))


def stream_sessions(ticks: DataFrame, gap: str = "5 minutes", late: str | None = "10 minutes", key: str = "symbol") -> DataFrame:
    """Runs of ticks of a key without a longer gap."""
    if late:
        ticks = ticks.withWatermark("ts", late)
    rows = ticks.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n_rows"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return rows.select(key, "start", "end", "n_rows")


#: numpy's and pandas' mark of a time that is none.
_NO_TIME = -(1 << 63)


def _with_held(held: bytes, frames, kinds: list[tuple[str, str]]):
    """The rows that a state holds as bytes and those of pandas frames, as one array of records. Times are in microseconds."""
    import numpy as np

    parts = [np.frombuffer(held, kinds)]
    for pdf in frames:
        part = np.empty(len(pdf), kinds)
        for name, _ in kinds:
            part[name] = pdf[name].astype("datetime64[us]").astype("int64") if name == "ts" else pdf[name]
        parts.append(part)
    return np.concatenate(parts)


def _wake(held, times) -> None:
    """Has a key whose oldest row is at `times[0]` looked at once the watermark has passed that row."""
    if len(times):
        held.setTimeoutTimestamp(max(int(times[0]) // 1000 + 1, held.getCurrentWatermarkMs() + 1))


def stream_asof(both: DataFrame, key: str = "symbol", late: str = "10 minutes") -> DataFrame:
    """As-of joins of a stream of two sides: rows (symbol, ts, side, id, value), side 'bar' or 'sparse'.

    For each bar: symbol, id, ts, match_ts, value of the last sparse row at or before it. State is, for each key, the rows that the
    watermark has not passed, as bytes, and the last sparse row before them: bars are given, in order, once the watermark has passed
    them. Rows without a time take no part.
    """
    state = "held_rows binary, last_ts bigint, last_value double"
    out = f"{key} string, id long, ts timestamp, match_ts timestamp, value double"
    kinds = [("ts", "<i8"), ("bar", "?"), ("id", "<i8"), ("value", "<f8")]

    def step(k, frames, held):
        import numpy as np
        import pandas as pd

        kept, last_ts, last_value = held.get if held.exists else (b"", None, None)
        rows = _with_held(kept, frames, kinds)
        rows = rows[np.lexsort((rows["id"], rows["bar"], rows["ts"]))]
        cut = np.searchsorted(rows["ts"], held.getCurrentWatermarkMs() * 1000)
        given, rest = rows[:cut], rows[cut:]
        sparse = np.maximum.accumulate(np.where(given["bar"], -1, np.arange(cut)))  # the last sparse row so far, -1: that of the state
        match = np.append(given["ts"], _NO_TIME if last_ts is None else last_ts)[sparse]
        value = np.append(given["value"], np.nan if last_value is None else last_value)[sparse]
        if cut and sparse[-1] >= 0:
            last_ts, last_value = int(match[-1]), None if np.isnan(value[-1]) else float(value[-1])
        held.update((rest.tobytes(), last_ts, last_value))
        _wake(held, rest["ts"])
        bar = given["bar"]
        if bar.any():
            yield pd.DataFrame({key: [k[0]] * int(bar.sum()), "id": given["id"][bar], "ts": given["ts"][bar].view("<M8[us]"), "match_ts": match[bar].view("<M8[us]"), "value": value[bar]})

    both = both.filter(F.col("ts").isNotNull()).select(key, "ts", (F.col("side") == "bar").alias("bar"), "id", "value")
    return both.withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, out, state, "append", "EventTimeTimeout")


def stream_windows(rows: DataFrame, spec: WindowSpec = WindowSpec(), key: str = "symbol", late: str = "10 minutes") -> DataFrame:
    """Windows of a stream of rows (symbol, ts, id, value), as windows.create_windows makes of a table: key, start_index, start_ts, end_ts
    (in ms) and values of each full window at a stride place without too long a gap, in the order of ts and id.

    A window is given, once, when the watermark has passed its last row. State is, for each key, the rows that it has not passed, the
    ring of the last rows before them, one less than `length`, both as bytes, and how many there were. Rows without a time take no part.
    """
    state = "held_rows binary, ring binary, passed_rows bigint"
    out = f"{key} string, start_index long, start_ts long, end_ts long, values array<double>"
    length, stride, max_gap = spec.length, spec.stride, spec.max_gap_ms
    kinds = [("ts", "<i8"), ("id", "<i8"), ("value", "<f8")]

    def step(k, frames, held):
        import numpy as np
        import pandas as pd

        kept, ring, n = held.get if held.exists else (b"", b"", 0)
        now = _with_held(kept, frames, kinds)
        now = now[np.lexsort((now["id"], now["ts"]))]
        cut = int(np.searchsorted(now["ts"], held.getCurrentWatermarkMs() * 1000))
        ring, rest = np.frombuffer(ring, kinds), now[cut:]
        near = np.concatenate([ring, now[:cut]])  # what windows that end in a row that is passed now are made of
        before, n = n - len(ring), n + cut
        first = -(-max(before + len(ring) - length + 1, 0) // stride) * stride
        starts = np.arange(first, n - length + 1, stride)
        at, ms = starts - before, near["ts"] // 1000
        if len(at):
            wide = np.append(0, np.cumsum(np.diff(ms) > max_gap))
            whole = wide[at + length - 1] == wide[at]
            starts, at = starts[whole], at[whole]
        held.update((rest.tobytes(), near[max(0, len(near) - length + 1) :].tobytes(), n))
        _wake(held, rest["ts"])
        if len(at):
            values = np.lib.stride_tricks.sliding_window_view(near["value"], length)[at]
            yield pd.DataFrame({key: [k[0]] * len(at), "start_index": starts, "start_ts": ms[at], "end_ts": ms[at + length - 1], "values": list(values)})

    rows = rows.filter(F.col("ts").isNotNull()).select(key, "ts", "id", "value")
    return rows.withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, out, state, "append", "EventTimeTimeout")
