"""The query catalogue over the provided tables, and the same queries in SQL.

Ticks are events: symbol is event_type, price is value, qty is a number of props, and event_id breaks ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import FUNDING, OPEN_INTEREST, ValidationRules, WindowSpec
from .functions import numbers as N
from .functions import vectors as V
from .functions.time import calendar_fields, epoch_ms
from .operators import align, asof, features, metrics, nearest, quality, resample, sampling, stats, windows
from .plans import catalog
from .sources.calendar import calendar, grid

HOUR = 3_600_000
#: Ticks are about 22 minutes apart for each symbol at sf0.01, so windows are of hourly bars.
SPEC = WindowSpec(length=8, stride=4, max_gap_ms=2 * HOUR)

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    def keep(f: Query) -> Query:
        _queries[name or f.__name__] = f
        if sql:
            _sql[name or f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("symbol"), epoch_ms(F.col("ts")).alias("timestamp"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("qty"), (F.col("user_id") % 2 == 0).alias("is_buyer_maker"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.bars(ticks(spark, sf_dir), HOUR)


TICKS = "t AS (SELECT event_id, event_type AS symbol, epoch_us(ts) // 1000 AS timestamp, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty, user_id % 2 = 0 AS is_buyer_maker FROM events)"


def bars_sql(ms: int, name: str = "b") -> str:
    return f"""{name} AS (SELECT symbol, (timestamp // {ms}) * {ms} AS timestamp, arg_min(price, (timestamp, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (timestamp, event_id)) AS close,
  sum(qty) AS volume, count(*) AS constituent_count, (timestamp // {ms}) * {ms} + {ms - 1} AS close_time FROM t GROUP BY symbol, timestamp // {ms})"""


for _name, _ms in (("1h", HOUR), ("4h", 4 * HOUR), ("1d", 24 * HOUR)):
    register(f"WITH {TICKS}, {bars_sql(_ms)} SELECT * FROM b", f"bars_{_name}")(lambda spark, sf_dir, ms=_ms: resample.bars(ticks(spark, sf_dir), ms))


@register(f"WITH {TICKS}, {bars_sql(HOUR)}, r AS (SELECT symbol, (timestamp // 14400000) * 14400000 AS bucket, arg_min(open, timestamp) AS open, max(high) AS high, min(low) AS low, arg_max(close, timestamp) AS close, sum(volume) AS volume, count(*) AS constituent_count FROM b GROUP BY symbol, timestamp // 14400000) SELECT symbol, bucket AS timestamp, open, high, low, close, volume, constituent_count, bucket + 14399999 AS close_time, constituent_count >= 240 AS complete, CASE WHEN constituent_count >= 240 THEN 'RESAMPLED' ELSE 'RESAMPLED_INCOMPLETE' END AS status FROM r")
def resample_4h_status(spark, sf_dir):
    return resample.resample(hourly(spark, sf_dir), "4h")


@register(f"WITH {TICKS}, {bars_sql(4 * HOUR)} SELECT count(*) AS matched, CAST(0 AS DOUBLE) AS open_diff, CAST(0 AS DOUBLE) AS high_diff, CAST(0 AS DOUBLE) AS low_diff, CAST(0 AS DOUBLE) AS close_diff, CAST(0 AS DOUBLE) AS volume_diff FROM b")
def bars_cascade_check(spark, sf_dir):
    return resample.verify_resample(hourly(spark, sf_dir), resample.bars(ticks(spark, sf_dir), 4 * HOUR), "4h")


@register(f"WITH {TICKS} SELECT symbol, (timestamp // 60000) * 60000 AS timestamp, count(*) AS trade_count, sum(qty) AS base_volume, round(sum(price * qty), 6) AS quote_volume, sum(CASE WHEN is_buyer_maker THEN 0 ELSE qty END) AS taker_buy_volume, sum(CASE WHEN is_buyer_maker THEN qty ELSE 0 END) AS taker_sell_volume, CAST(sum(CASE WHEN is_buyer_maker THEN 0 ELSE 1 END) AS BIGINT) AS taker_buy_count, CAST(sum(CASE WHEN is_buyer_maker THEN 1 ELSE 0 END) AS BIGINT) AS taker_sell_count FROM t GROUP BY symbol, timestamp // 60000")
def trades_to_minute(spark, sf_dir):
    return align.trades_to_minute(ticks(spark, sf_dir)).withColumn("quote_volume", F.round("quote_volume", 6))


@register(f"WITH {TICKS}, m AS (SELECT symbol, (timestamp // 60000) * 60000 AS timestamp, sum(CASE WHEN is_buyer_maker THEN 0 ELSE qty END) AS v, count(*) AS n FROM t GROUP BY 1, 2), g AS (SELECT symbol, unnest(generate_series((SELECT min(timestamp) FROM m), (SELECT max(timestamp) FROM m), 60000)) AS timestamp FROM (SELECT DISTINCT symbol FROM m)) SELECT g.symbol, g.timestamp, coalesce(v, 0) AS taker_buy_volume, coalesce(n, 0) AS trade_count FROM g LEFT JOIN m USING (symbol, timestamp)")
def taker_volume_zero_filled(spark, sf_dir):
    t = ticks(spark, sf_dir)
    low, high = t.agg(F.min("timestamp"), F.max("timestamp")).first()
    minutes = grid(spark, low // 60_000 * 60_000, high // 60_000 * 60_000).withColumn("symbol", F.explode(symbols(t)))
    return align.on_grid(align.trades_to_minute(t), minutes).select("symbol", "timestamp", "taker_buy_volume", "trade_count")


def _two_sides(spark, sf_dir, injected: bool = False):
    """All symbols' ticks of even ids, and those of odd ids as a sparse modality of the same symbol; injected: every third of these
    has a null value."""
    t = ticks(spark, sf_dir)
    left = t.filter("event_id % 2 = 0").select("symbol", "event_id", "timestamp", "price")
    value = F.when(F.col("event_id") % 3 != 0, F.col("price")) if injected else F.col("price")
    right = t.filter("event_id % 2 = 1").select("symbol", F.col("event_id").alias("right_id"), "timestamp", value.alias("value"))
    return left, right


SIDES = f"WITH {TICKS}, l AS (SELECT symbol, event_id, timestamp, price FROM t WHERE event_id % 2 = 0), r AS (SELECT symbol, max(event_id) AS right_id, timestamp AS rt, arg_max(price, event_id) AS value FROM t WHERE event_id % 2 = 1 GROUP BY symbol, timestamp)"


@register(f"{SIDES} SELECT event_id, timestamp, rt AS match_timestamp, value, rt IS NULL OR timestamp - rt > 300000 AS stale FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.timestamp >= r.rt")
def asof_backward_stale(spark, sf_dir):
    left, right = _two_sides(spark, sf_dir)
    found = asof.asof(left, right, ["symbol"], ["value"], tie="right_id")
    age = F.col("timestamp") - F.col("match_timestamp")
    return found.select("event_id", "timestamp", "match_timestamp", "value", (age.isNull() | (age > 300_000)).alias("stale"))


@register(f"{SIDES} SELECT event_id, timestamp, rt AS match_timestamp, value FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.timestamp <= r.rt")
def asof_forward(spark, sf_dir):
    left, right = _two_sides(spark, sf_dir)
    return asof.asof(left, right, ["symbol"], ["value"], tie="right_id", direction="forward").select("event_id", "timestamp", "match_timestamp", "value")


@register(f"{SIDES} SELECT event_id, timestamp, CASE WHEN timestamp - rt <= 600000 THEN rt END AS match_timestamp, CASE WHEN timestamp - rt <= 600000 THEN value END AS value FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.timestamp >= r.rt")
def asof_tolerance(spark, sf_dir):
    left, right = _two_sides(spark, sf_dir)
    return asof.asof(left, right, ["symbol"], ["value"], tie="right_id", tolerance_ms=600_000).select("event_id", "timestamp", "match_timestamp", "value")


@register(f"{SIDES} SELECT event_id, rt AS match_timestamp, value FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.timestamp > r.rt")
def asof_strict_snapshot(spark, sf_dir):
    left, right = _two_sides(spark, sf_dir)
    return asof.asof(left, right, ["symbol"], ["value"], tie="right_id", strict=True).select("event_id", "match_timestamp", "value")


@register(f"{SIDES}, m AS (SELECT l.symbol, event_id, timestamp, CASE WHEN right_id % 3 <> 0 THEN value END AS value FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.timestamp >= r.rt) SELECT event_id, timestamp, last_value(value IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM m")
def ffill_after_match(spark, sf_dir):
    left, right = _two_sides(spark, sf_dir, injected=True)
    found = asof.asof(left, right, ["symbol"], ["value"], tie="right_id")
    return asof.forward_fill(found, ["symbol"], ["value"], tie=["event_id"]).select("event_id", "timestamp", "value")


def symbols(rows: DataFrame) -> Column:
    """The symbols of `rows` as an array, a constant of the plan: a text for each event type."""
    return F.array(*[F.lit(r.symbol) for r in rows.select("symbol").distinct().orderBy("symbol").collect()])


def _state(spark, sf_dir) -> DataFrame:
    """Hourly bars of all symbols, with errors as funding and purchases as open interest of every symbol."""
    t, b = ticks(spark, sf_dir), hourly(spark, sf_dir)
    names = symbols(t)

    def side(kind: str, value: str) -> DataFrame:
        rows = t.filter(F.col("symbol") == kind).groupBy("timestamp").agg(F.max_by("price", "event_id").alias(value))
        return rows.withColumn("symbol", F.explode(names))

    return align.market_state(b.drop("constituent_count"), side("error", "funding_rate"), side("purchase", "open_interest"), policies=(FUNDING, OPEN_INTEREST))


STATE = f"""WITH {TICKS}, {bars_sql(HOUR)}, s AS (SELECT symbol, close_time AS timestamp, open, high, low, close, volume, close_time FROM b),
f AS (SELECT timestamp AS ft, arg_max(price, event_id) AS funding_rate FROM t WHERE symbol = 'error' GROUP BY 1), o AS (SELECT timestamp AS ot, arg_max(price, event_id) AS open_interest FROM t WHERE symbol = 'purchase' GROUP BY 1),
sf AS (SELECT s.*, ft, funding_rate FROM s ASOF LEFT JOIN f ON s.timestamp >= f.ft), so AS (SELECT sf.*, ot, open_interest FROM sf ASOF LEFT JOIN o ON sf.timestamp >= o.ot),
state AS (SELECT symbol, timestamp, open, high, low, close, volume, close_time, funding_rate, ft IS NULL OR timestamp - ft > 28800000 AS funding_rate_stale, open_interest, ot IS NULL OR timestamp - ot > 300000 AS open_interest_stale,
  CAST(hour(d) * 60 + minute(d) AS INT) AS minute_of_day, CAST(hour(d) AS INT) AS hour, CAST(isodow(d) - 1 AS INT) AS day_of_week, CAST(day(d) AS INT) AS day_of_month, CAST(month(d) AS INT) AS month, CAST(quarter(d) AS INT) AS quarter, CAST(year(d) AS INT) AS year, CAST(CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS TINYINT) AS is_weekend
  FROM (SELECT *, make_timestamp((timestamp // 60000) * 60000000) AS d FROM so))"""


@register(f"{STATE} SELECT * FROM state")
def market_state(spark, sf_dir):
    return _state(spark, sf_dir)


@register(f"{STATE} SELECT symbol, count(*) AS total_rows, count(funding_rate) AS funding_rows, count(open_interest) AS oi_rows FROM state GROUP BY symbol")
def alignment_coverage(spark, sf_dir):
    return align.coverage(_state(spark, sf_dir))


@register("SELECT o_orderkey, CAST(hour(o_orderdate) * 60 + minute(o_orderdate) AS INT) AS minute_of_day, CAST(hour(o_orderdate) AS INT) AS hour, CAST(isodow(o_orderdate) - 1 AS INT) AS day_of_week, CAST(day(o_orderdate) AS INT) AS day_of_month, CAST(month(o_orderdate) AS INT) AS month, CAST(quarter(o_orderdate) AS INT) AS quarter, CAST(year(o_orderdate) AS INT) AS year, CAST(CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS TINYINT) AS is_weekend FROM orders")
def calendar_fields_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", *[v.alias(k) for k, v in calendar_fields(epoch_ms(F.col("o_orderdate"))).items()])


@register("SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(quarter(o_orderdate) AS INT) AS quarter, CAST(CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS TINYINT) AS is_weekend, count(*) AS orders, CAST(sum(isodow(o_orderdate) - 1) AS BIGINT) AS days FROM orders GROUP BY ALL")
def calendar_grid(spark, sf_dir):
    """All orders on the minutes of their years' calendars."""
    o = table(spark, sf_dir, "orders").select(epoch_ms(F.col("o_orderdate")).alias("at"))
    low, high = o.agg(*[F.year(F.timestamp_millis(f("at"))) for f in (F.min, F.max)]).first()
    minutes = None
    for year in range(low, high + 1):
        minutes = calendar(spark, year) if minutes is None else minutes.unionByName(calendar(spark, year))
    on = o.withColumn("timestamp", F.floor(F.col("at") / 60_000) * 60_000).join(minutes, "timestamp")
    return on.groupBy("year", "quarter", "is_weekend").agg(F.count("*").alias("orders"), F.sum(F.col("day_of_week").cast("long")).alias("days"))


def _exploded(packed: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return packed.select("symbol", "timestamp", *[F.round(F.col("features")[i].cast("double"), 4).alias(n) for i, n in enumerate(names)], *[F.col("feature_mask")[i].alias(f"{n}_seen") for i, n in enumerate(names)])


RAW = ("open", "high", "low", "close", "volume", "funding_rate", "open_interest")


@register(f"{STATE} SELECT symbol, timestamp, {', '.join(f'round(CAST(CAST(coalesce({c}, 0) AS FLOAT) AS DOUBLE), 4) AS {c}' for c in RAW)}, {', '.join(f'{c} IS NOT NULL' + (f' AND NOT {c}_stale' if c in RAW[5:] else '') + f' AS {c}_seen' for c in RAW)} FROM state")
def features_raw(spark, sf_dir):
    return _exploded(features.raw_features(_state(spark, sf_dir)), RAW)


RETURNS = ("log_return", "hl_range", "oc_body", "log_volume", "volume_change", "funding_rate", "open_interest")
RETURN_SQL = f"""{STATE}, v AS (SELECT symbol, timestamp, funding_rate_stale, open_interest_stale, CASE WHEN close / nullif(lag(close) OVER w, 0) > 0 THEN ln(close / nullif(lag(close) OVER w, 0)) END AS log_return, (high - low) / nullif(close, 0) AS hl_range, (close - open) / nullif(close, 0) AS oc_body,
ln(1 + greatest(volume, 0)) AS log_volume, ln(1 + greatest(volume, 0)) - lag(ln(1 + greatest(volume, 0))) OVER w AS volume_change, funding_rate, CASE WHEN open_interest IS NOT NULL THEN ln(1 + greatest(open_interest, 0)) END AS open_interest FROM state WINDOW w AS (PARTITION BY symbol ORDER BY timestamp))"""


@register(f"{RETURN_SQL} SELECT symbol, timestamp, {', '.join(f'round(CAST(CAST(coalesce({c}, 0) AS FLOAT) AS DOUBLE), 4) AS {c}' for c in RETURNS)}, {', '.join(f'{c} IS NOT NULL' + (f' AND NOT {c}_stale' if c in RETURNS[5:] else '') + f' AS {c}_seen' for c in RETURNS)} FROM v")
def features_returns(spark, sf_dir):
    return _exploded(features.return_features(_state(spark, sf_dir)), RETURNS)


@register(f"{RETURN_SQL} SELECT * FROM (SELECT unnest([{', '.join(repr(c) for c in RETURNS)}]) AS feature, unnest([{', '.join(f'CAST(sum(CASE WHEN {c} IS NOT NULL' + (f' AND NOT {c}_stale' if c in RETURNS[5:] else '') + ' THEN 1 ELSE 0 END) AS BIGINT)' for c in RETURNS)}]) AS observed, count(*) AS total FROM v)")
def feature_mask_rate(spark, sf_dir):
    from .config import RETURN_FEATURES

    rates = features.mask_rate(features.return_features(_state(spark, sf_dir)), RETURN_FEATURES)
    return rates.filter(F.col("feature").isin(list(RETURNS)))


SERIES = f"WITH {TICKS}, {bars_sql(HOUR)}, g AS (SELECT *, row_number() OVER w - 1 AS i, lead(timestamp) OVER w - timestamp AS gap FROM b WINDOW w AS (PARTITION BY symbol ORDER BY timestamp))"
WINDOWS = f"{SERIES}, e AS (SELECT symbol, i, timestamp AS start_ts, last_value(timestamp) OVER a AS end_ts, count(*) OVER a AS n, max(gap) OVER s AS max_gap, min(gap) OVER s AS min_gap FROM g WINDOW a AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), s AS (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)), c AS (SELECT * FROM e WHERE n = 8 AND i % 4 = 0), win AS (SELECT * FROM c WHERE max_gap <= 7200000)"


@register(f"{WINDOWS} SELECT symbol, i AS start_index, start_ts, end_ts, end_ts - start_ts AS span_ms, max_gap AS max_gap_ms, min_gap AS min_gap_ms, max_gap <= 60000 AS contiguous FROM win")
def windows_meta(spark, sf_dir):
    return windows.window_starts(hourly(spark, sf_dir), SPEC)


@register(f"{WINDOWS} SELECT symbol, count(*) AS candidates, CAST(sum(CASE WHEN max_gap > 7200000 THEN 1 ELSE 0 END) AS BIGINT) AS rejected FROM c GROUP BY symbol")
def windows_gap_rejects(spark, sf_dir):
    return windows.rejected(hourly(spark, sf_dir), SPEC)


def _windows(spark, sf_dir) -> DataFrame:
    b = hourly(spark, sf_dir).withColumn("volume", F.when(F.col("volume") > 20, F.col("volume")))
    return windows.create_windows(features.raw_features(b.select("symbol", "timestamp", "volume"), order=("volume",)), SPEC)


@register(f"{WINDOWS}, x AS (SELECT w.symbol, w.start_ts, r.timestamp, r.gap, r.i - w.i AS pos, r.volume > 20 AS seen FROM win w JOIN g r ON r.symbol = w.symbol AND r.i BETWEEN w.i AND w.i + 7), m AS (SELECT symbol, start_ts, median(gap) AS med FROM x WHERE pos < 7 GROUP BY ALL) SELECT x.symbol, x.start_ts, CAST(sum(CASE WHEN coalesce(seen, false) AND (pos = 7 OR gap <= 2 * floor(med)) THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN seen THEN 1 ELSE 0 END) AS BIGINT) AS seen FROM x JOIN m USING (symbol, start_ts) GROUP BY ALL")
def window_position_mask(spark, sf_dir):
    w = _windows(spark, sf_dir)
    return w.select("symbol", F.col("metadata.start_ts").alias("start_ts"), F.size(F.filter("mask", lambda x: x)).cast("long").alias("kept"), F.size(F.filter("feature_mask", lambda r: r[0])).cast("long").alias("seen"))


@register(f"{WINDOWS} SELECT w.symbol, w.start_ts, list(r.timestamp ORDER BY r.timestamp) AS timestamps, CAST(max((r.timestamp - w.start_ts) // 60000) + 1 AS BIGINT) AS last_position FROM win w JOIN g r ON r.symbol = w.symbol AND r.i BETWEEN w.i AND w.i + 7 GROUP BY w.symbol, w.start_ts")
def positions_minute(spark, sf_dir):
    w = _windows(spark, sf_dir)
    return w.select("symbol", F.col("metadata.start_ts").alias("start_ts"), "timestamps", F.array_max(V.minute_positions(F.col("timestamps"))).alias("last_position"))


@register(f"{WINDOWS} SELECT w.symbol, w.start_ts, round(coalesce(sum(CASE WHEN r.volume > 20 THEN r.volume END) / greatest(count(CASE WHEN r.volume > 20 THEN 1 END), 1), 0), 4) AS pooled FROM win w JOIN g r ON r.symbol = w.symbol AND r.i BETWEEN w.i AND w.i + 7 GROUP BY w.symbol, w.start_ts")
def mean_pool_masked(spark, sf_dir):
    w = _windows(spark, sf_dir)
    seen = F.transform("feature_mask", lambda r: r[0])
    return w.select("symbol", F.col("metadata.start_ts").alias("start_ts"), F.round(V.mean_pooling(F.col("features"), seen, 1)[0], 4).alias("pooled"))


STATS = f"""{WINDOWS}, lr AS (SELECT *, ln(greatest(close, 1e-12)) - lag(ln(greatest(close, 1e-12))) OVER (PARTITION BY symbol ORDER BY timestamp) AS lr, (high - low) / greatest(close, 1e-12) AS rel FROM g),
st AS (SELECT w.symbol, w.start_ts, w.end_ts, stddev_pop(CASE WHEN r.i > w.i THEN lr END) AS volatility, avg(rel) AS range, avg(volume) AS volume, arg_max(lr, r.i) AS last_return, avg(CASE WHEN r.i > w.i THEN abs(lr) END) AS abs_return_mean, avg(CASE WHEN r.i > w.i THEN CASE WHEN lr > 0 THEN 1.0 ELSE 0.0 END END) AS up_ratio, max(CASE WHEN r.i > w.i THEN abs(lr) END) AS max_abs_return,
 avg(CASE WHEN r.i > w.i THEN lr * lr * lr END) - 3 * avg(CASE WHEN r.i > w.i THEN lr END) * avg(CASE WHEN r.i > w.i THEN lr * lr END) + 2 * power(avg(CASE WHEN r.i > w.i THEN lr END), 3) AS third FROM win w JOIN lr r ON r.symbol = w.symbol AND r.i BETWEEN w.i AND w.i + 7 GROUP BY w.symbol, w.start_ts, w.end_ts)"""
STAT_NAMES = ("volatility", "range", "volume", "last_return", "abs_return_mean", "up_ratio", "max_abs_return", "return_skew")


@register(f"{STATS} SELECT symbol, start_ts, end_ts, {', '.join(f'round({c}, 5) AS {c}' for c in STAT_NAMES[:-1])}, round(third / greatest(power(volatility, 3), 1e-12), 4) AS return_skew FROM st")
def window_stats(spark, sf_dir):
    s = windows.window_stats(hourly(spark, sf_dir), SPEC)
    return s.select("symbol", "start_ts", "end_ts", *[F.round(c, 5).alias(c) for c in STAT_NAMES[:-1]], F.round("return_skew", 4).alias("return_skew"))


@register(f"{STATS} SELECT symbol, start_ts, round(volatility + range + ln(1 + volume) + abs_return_mean + last_return + up_ratio + max_abs_return, 4) AS total FROM st")
def handcrafted_vector(spark, sf_dir):
    s = windows.window_stats(hourly(spark, sf_dir), SPEC).withColumn("v", windows.handcrafted_vector())
    return s.select("symbol", "start_ts", F.round(F.aggregate(F.slice("v", 1, 7), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


LABELS = f"{WINDOWS}, n AS (SELECT w.symbol, w.start_ts, w.end_ts, arg_max(b.close, b.timestamp) AS close_now FROM win w JOIN b ON b.symbol = w.symbol AND b.timestamp <= w.end_ts GROUP BY ALL), l AS (SELECT n.symbol, n.start_ts, n.end_ts, any_value(close_now) AS close_now, arg_min(b.close, b.timestamp) AS close_future FROM n JOIN b ON b.symbol = n.symbol AND b.timestamp >= n.end_ts + 10800000 GROUP BY ALL)"
LABEL_OUT = "SELECT symbol, start_ts, end_ts, close_now, close_future, CASE WHEN least(close_now, close_future) <= 0 THEN 0 WHEN close_future > close_now THEN 1 ELSE 0 END AS label FROM l"


@register(f"{LABELS} {LABEL_OUT} WHERE close_now > 0 AND close_future > 0")
def future_return_labels(spark, sf_dir):
    b = hourly(spark, sf_dir)
    return windows.future_labels(windows.window_starts(b, SPEC).select("symbol", "start_ts", "end_ts"), b, 3 * HOUR)


BUDGET = 1_705_276_800_000  # 2024-01-15


@register(f"{LABELS} {LABEL_OUT} WHERE end_ts + 10800000 <= {BUDGET} AND close_now > 0 AND close_future > 0")
def label_budget(spark, sf_dir):
    b = hourly(spark, sf_dir)
    return windows.future_labels(windows.window_starts(b, SPEC).select("symbol", "start_ts", "end_ts"), b, 3 * HOUR, BUDGET)


@register(f"{WINDOWS} SELECT symbol, CAST(sum(CASE WHEN end_ts < {BUDGET} THEN 1 ELSE 0 END) AS BIGINT) AS train, CAST(sum(CASE WHEN start_ts >= {BUDGET} THEN 1 ELSE 0 END) AS BIGINT) AS test FROM win GROUP BY symbol")
def split_train_test(spark, sf_dir):
    w = windows.window_starts(hourly(spark, sf_dir), SPEC)
    both = windows.split(w, "train", BUDGET).withColumn("which", F.lit("train")).unionByName(windows.split(w, "test", BUDGET).withColumn("which", F.lit("test")))
    return both.groupBy("symbol").agg(F.sum((F.col("which") == "train").cast("long")).alias("train"), F.sum((F.col("which") == "test").cast("long")).alias("test"))


@register(f"WITH {TICKS} SELECT symbol FROM t GROUP BY symbol HAVING min(timestamp) < {BUDGET} AND max(timestamp) >= {BUDGET} + 86400000")
def split_disjoint(spark, sf_dir):
    """Symbols of both splits when these are of time alone: all that trade throughout."""
    t = ticks(spark, sf_dir)
    return windows.shared_symbols(t.filter(F.col("timestamp") < BUDGET), t.filter(F.col("timestamp") >= BUDGET + 86_400_000))


LINE = ("l_quantity", "l_extendedprice", "l_discount")


@register(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM lineitem" for c in LINE))
def zscore_fit(spark, sf_dir):
    return stats.zscore_fit(table(spark, sf_dir, "lineitem"), list(LINE)).select("column", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register("SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_samp(l_quantity) FROM lineitem), 6) AS l_quantity FROM lineitem")
def zscore_apply(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    found = stats.Normalizer("zscore").fit(rows, ["l_quantity"]).transform(rows)
    return found.withColumn("l_quantity", F.round("l_quantity", 6))


@register(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(quantile_disc({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr FROM lineitem" for c in LINE))
def robust_fit(spark, sf_dir):
    return stats.robust_fit(table(spark, sf_dir, "lineitem"), list(LINE)).select("column", F.round("median", 6).alias("median"), F.round("iqr", 6).alias("iqr"))


@register("SELECT event_id, round(ln(1 + abs(value)), 6) AS logged FROM events")
def log_transform(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(N.log_transform(F.col("value")), 6).alias("logged"))


@register("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice > (SELECT median(l_extendedprice) FROM lineitem) THEN 1 ELSE 0 END AS y FROM lineitem")
def thresholds_binarize(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    limit = stats.threshold_values(rows, ["l_extendedprice"])["l_extendedprice"]
    return rows.select("l_orderkey", "l_linenumber", N.above(F.col("l_extendedprice"), F.lit(limit).cast("double")).alias("y"))


@register("SELECT l_suppkey, round(median(l_extendedprice), 6) AS l_extendedprice_threshold, round(median(l_quantity), 6) AS l_quantity_threshold FROM lineitem GROUP BY l_suppkey")
def medians_by_key(spark, sf_dir):
    found = stats.thresholds(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"], ["l_suppkey"])
    return found.select("l_suppkey", *[F.round(c, 6).alias(c) for c in found.columns if c != "l_suppkey"])


@register(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 6) AS mean, round(coalesce(stddev_samp({c}), 0), 6) AS std FROM {t}" for t, cs in (("lineitem", LINE), ("orders", ("o_totalprice", "o_custkey"))) for c in cs))
def describe_numeric(spark, sf_dir):
    a = stats.describe(table(spark, sf_dir, "lineitem"), list(LINE))
    b = stats.describe(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"])
    return a.unionByName(b).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@register(f"WITH {TICKS}, {bars_sql(HOUR)} SELECT 'high_gte_low' AS rule, CAST(coalesce(sum(CASE WHEN high < low THEN 1 ELSE 0 END), 0) AS BIGINT) AS bad_count FROM b UNION ALL SELECT 'close_positive', CAST(coalesce(sum(CASE WHEN close <= 0 THEN 1 ELSE 0 END), 0) AS BIGINT) FROM b")
def validate_bars(spark, sf_dir):
    return quality.rule_counts(hourly(spark, sf_dir), "klines")


@register("SELECT 'valid_side' AS rule, CAST(sum(CASE WHEN l_returnflag IN ('BUY', 'SELL') THEN 0 ELSE 1 END) AS BIGINT) AS bad_count FROM lineitem UNION ALL SELECT 'quantity_gt_zero', CAST(sum(CASE WHEN l_quantity - 25 <= 0 THEN 1 ELSE 0 END) AS BIGINT) FROM lineitem")
def validate_enum(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("side"), (F.col("l_quantity") - 25).alias("quantity"))
    return quality.rule_counts(rows, "liquidations")


@register(f"WITH {TICKS}, d AS (SELECT symbol, timestamp, timestamp - lag(timestamp) OVER (PARTITION BY symbol ORDER BY event_id) AS delta FROM t), c AS (SELECT symbol, sum(CASE WHEN delta < 0 THEN 1 ELSE 0 END) AS a, count(timestamp) - count(DISTINCT timestamp) AS b, sum(CASE WHEN delta > 300000 THEN 1 ELSE 0 END) AS g FROM d GROUP BY symbol) SELECT symbol, unnest(['not_monotonic', 'duplicate_timestamps', 'gaps']) AS rule, unnest([CAST(a AS BIGINT), CAST(b AS BIGINT), CAST(g AS BIGINT)]) AS bad_count FROM c")
def validate_timestamps(spark, sf_dir):
    return quality.timestamp_report(ticks(spark, sf_dir), "aggTrades", ValidationRules(), ("symbol",), row_order="event_id")


@register("SELECT 'missing_value' AS rule, CAST(sum(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_count FROM lineitem")
def validate_funding_missing(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.nullif(F.col("l_discount"), F.lit(0.0)).alias("funding_rate"))
    return quality.rule_counts(rows, "funding")


@register(f"{STATE}, d AS (SELECT *, timestamp - lag(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp) AS delta FROM state), c AS (SELECT symbol, count(*) AS total_records, CAST(sum(CASE WHEN delta > 60000 THEN 1 ELSE 0 END) AS BIGINT) AS gap_count, coalesce(max(delta), 0) AS largest_gap_ms, count(*) - count(funding_rate) AS missing_funding_rate, count(*) - count(open_interest) AS missing_open_interest FROM d GROUP BY symbol) SELECT symbol, total_records, gap_count, largest_gap_ms, missing_funding_rate, missing_open_interest, 0 AS duplicate_rows, round((total_records - missing_funding_rate) / total_records, 4) AS funding_rate_coverage, greatest(100.0 - least(gap_count * 1.0, 30.0) - least((missing_funding_rate + missing_open_interest) * 0.5, 20.0), 0) AS quality_score FROM c")
def quality_report(spark, sf_dir):
    report = quality.quality_report(_state(spark, sf_dir))
    return report.select("symbol", "total_records", "gap_count", "largest_gap_ms", "missing_funding_rate", "missing_open_interest", "duplicate_rows", "funding_rate_coverage", "quality_score")


@register("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1")
def dedupe_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return quality.keep_first(rows, ["l_orderkey"], ["l_linenumber", "l_partkey"])


@register(f"WITH {TICKS}, d AS (SELECT symbol, timestamp - lag(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp, event_id) AS gap FROM t) SELECT symbol, max(gap) AS largest, CAST(sum(CASE WHEN gap > 3600000 THEN 1 ELSE 0 END) AS BIGINT) AS over_an_hour FROM d GROUP BY symbol")
def gap_report(spark, sf_dir):
    t = ticks(spark, sf_dir).withColumn("day", asof.time_slot(F.col("timestamp")))
    rows = asof.lagged(t, ["symbol"], "day", [F.col("timestamp"), F.col("event_id")], {"before": F.col("timestamp")})
    return rows.select("symbol", (F.col("timestamp") - F.col("before")).alias("gap")).groupBy("symbol").agg(F.max("gap").alias("largest"), F.sum(F.coalesce((F.col("gap") > HOUR).cast("long"), F.lit(0))).alias("over_an_hour"))


@register(f"WITH {TICKS}, d AS (SELECT symbol, timestamp, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp) > 3600000 THEN 1 ELSE 0 END AS cut FROM t), s AS (SELECT symbol, timestamp, sum(cut) OVER (PARTITION BY symbol ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS segment FROM d) SELECT symbol, CAST(segment AS BIGINT) AS segment, min(timestamp) AS start_ts, max(timestamp) AS end_ts, count(*) AS n_rows FROM s GROUP BY ALL")
def session_segments(spark, sf_dir):
    return windows.gap_segments(ticks(spark, sf_dir), HOUR)


def _files(spark, sf_dir) -> DataFrame:
    """Orders as a catalogue of files: three of them, by date, have one id."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("f"), F.floor(F.col("o_orderkey") / 3)).alias("file_id"), F.col("o_orderpriority").alias("dataset_type"), F.col("o_orderstatus").alias("symbol"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
        F.concat(F.lit("p"), F.col("o_orderkey")).alias("path"), F.col("o_custkey").alias("row_count"), F.floor("o_totalprice").cast("long").alias("size_bytes"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderkey"),
    )


@register("SELECT o_orderpriority AS dataset_type, count(*) AS file_count, CAST(sum(o_custkey) AS BIGINT) AS total_rows, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total_bytes FROM orders GROUP BY 1")
def storage_summary(spark, sf_dir):
    return catalog.storage_summary(_files(spark, sf_dir), ("dataset_type",)).drop("total_mb")


@register("SELECT file_id, o_orderkey FROM (SELECT 'f' || (o_orderkey // 3) AS file_id, o_orderkey, row_number() OVER (PARTITION BY o_orderkey // 3 ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def catalog_latest_wins(spark, sf_dir):
    return catalog.latest(_files(spark, sf_dir), ["file_id"], [F.desc("created_at"), F.desc("o_orderkey")]).select("file_id", "o_orderkey")


@register("SELECT o_orderkey, symbol, year, month FROM (SELECT o_orderkey, o_orderstatus AS symbol, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month FROM orders) WHERE symbol = 'F' AND year = 1996")
def catalog_query(spark, sf_dir):
    return catalog.query_files(_files(spark, sf_dir), symbol="F", year=1996, month=0, dataset_type="").select("o_orderkey", "symbol", "year", "month")


@register("SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders")
def scd2_history(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("valid_from"))
    return o.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("o_custkey").orderBy("valid_from", "o_orderkey")))


@register("SELECT c_custkey AS symbol, c_mktsegment AS market_type, max(o_orderdate) AS valid_from FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def scd2_current(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    rows = c.join(o, c["c_custkey"] == o["o_custkey"]).select(F.col("c_custkey").alias("symbol"), F.col("c_mktsegment").alias("market_type"), F.col("o_orderdate").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(True).alias("is_active"))
    split = F.pmod(F.col("symbol"), F.lit(2)) == 0
    found = catalog.merge_assets(rows.filter(split), rows.filter(~split))
    return catalog.current_assets(found).select("symbol", "market_type", "valid_from")


@register("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0")
def orphan_antijoin(spark, sf_dir):
    files = _files(spark, sf_dir)
    return catalog.orphans(files, files.filter("o_orderkey % 7 <> 0").select("path")).select("o_orderkey")


def knn_sql(asked: str = "") -> str:
    """Of the vectors that `asked` names, or of all, the ten nearest of all vectors: table k."""
    return f"q AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[64]) AS v FROM embeddings), p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, a.label AS own, b.label AS theirs, list_cosine_similarity(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS s FROM q a JOIN q b ON a.vec_id <> b.vec_id{asked}), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 12) DESC, neighbour) AS rank FROM p QUALIFY rank <= 10)"


#: The queries that an index is tried with, against all vectors.
INDEX_QUERIES = "vec_id % 50 = 0"


def _near(spark, sf_dir, asked: str = "true") -> DataFrame:
    """Every vector's nearest of all, or those of the vectors that `asked` names."""
    e = table(spark, sf_dir, "embeddings")
    return nearest.neighbours(e.filter(asked), e)


@register(f"WITH {knn_sql()} SELECT query, neighbour, rank, round(s, 4) AS similarity FROM k")
def topk_neighbors(spark, sf_dir):
    """Every vector against every other."""
    return _near(spark, sf_dir).select("query", "neighbour", F.col("rank").cast("long").alias("rank"), F.round("similarity", 4).alias("similarity"))


@register(f"WITH {knn_sql(f' WHERE a.{INDEX_QUERIES}')} SELECT query, neighbour, rank, round(s, 4) AS similarity FROM k")
def topk_neighbors_indexed(spark, sf_dir):
    """The same through cells: a query meets the nearest ones, then those that may hold something nearer."""
    e = table(spark, sf_dir, "embeddings")
    found = nearest.search(nearest.build_index(e), e.filter(INDEX_QUERIES), exact=True)
    return found.select("query", "neighbour", F.col("rank").cast("long").alias("rank"), F.round("similarity", 4).alias("similarity"))


@register("SELECT 10 * count(*) AS pairs, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def index_recall(spark, sf_dir):
    """Of the exact neighbours, at least nine in ten are in the cells that are met first."""
    e = table(spark, sf_dir, "embeddings")
    index = nearest.build_index(e)
    found = nearest.search(index, e.filter(INDEX_QUERIES), probes=nearest.enough_probes(index))
    return nearest.recall(found, _near(spark, sf_dir, INDEX_QUERIES)).select("pairs", (F.col("recall") >= 0.9).alias("enough"))


@register(f"WITH {knn_sql()} SELECT round(avg(CASE WHEN own = theirs THEN 1.0 ELSE 0.0 END), 4) AS same_rate, round(1 - avg(CASE WHEN own = theirs THEN 1.0 ELSE 0.0 END), 4) AS cross_rate FROM k")
def knn_same_label_rate(spark, sf_dir):
    return metrics.retrieval_rates(_near(spark, sf_dir), table(spark, sf_dir, "embeddings"))


@register("WITH a AS (SELECT label AS symbol, vec_id, embedding, lead(embedding) OVER (ORDER BY vec_id) AS n, lead(label) OVER (ORDER BY vec_id) AS nl FROM embeddings) SELECT symbol, vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(n AS DOUBLE[])) / ((sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) + 1e-8) * (sqrt(list_dot_product(CAST(n AS DOUBLE[]), CAST(n AS DOUBLE[]))) + 1e-8)), 5) AS cosine FROM a WHERE nl = symbol")
def adjacent_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "symbol")
    return metrics.adjacent_cosines(e, ["vec_id"]).withColumn("cosine", F.round("cosine", 5))


NORMS = "n AS (SELECT vec_id, label, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings), g AS (SELECT vec_id, label, norm, CASE WHEN norm >= (SELECT median(norm) FROM n) THEN 1 ELSE 0 END AS regime FROM n)"


@register(f"WITH {NORMS} SELECT vec_id, round(norm, 5) AS norm, regime FROM g")
def embedding_norm_regime(spark, sf_dir):
    return metrics.norm_regime(table(spark, sf_dir, "embeddings")).select("vec_id", F.round("norm", 5).alias("norm"), "regime")


@register(f"WITH {NORMS}, c AS (SELECT label AS a, regime AS b, count(*) AS n FROM g GROUP BY ALL), ra AS (SELECT a, sum(n) AS s FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS s FROM c GROUP BY b), z AS (SELECT sum(n) AS t FROM c) SELECT round((SELECT sum(n / t * ln(t * n / (ra.s * rb.s))) FROM c JOIN ra USING (a) JOIN rb USING (b), z), 6) AS mi, round((SELECT -sum(s / t * ln(s / t)) FROM ra, z), 6) AS h_a, round((SELECT -sum(s / t * ln(s / t)) FROM rb, z), 6) AS h_b")
def contingency_mi(spark, sf_dir):
    rows = metrics.norm_regime(table(spark, sf_dir, "embeddings"))
    found = metrics.mutual_information(metrics.contingency(rows, "label", "regime"))
    return found.select(*[F.round(c, 6).alias(c) for c in ("mi", "h_a", "h_b")])


def _scored(spark, sf_dir) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return labels.join(d.select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("score"), (F.col("n_chars") > 1000).cast("int").alias("pred"), "toxic")


SCORED = "s AS (SELECT quality AS y, CAST(n_chars AS DOUBLE) AS score, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS pred FROM labels JOIN documents USING (doc_id))"


@register(f"WITH {SCORED} SELECT round(avg(r), 9) AS balanced_accuracy FROM (SELECT y, avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END) AS r FROM s GROUP BY y)")
def balanced_accuracy(spark, sf_dir):
    return metrics.balanced_accuracy(_scored(spark, sf_dir)).withColumn("balanced_accuracy", F.round("balanced_accuracy", 9))


@register(f"WITH {SCORED} SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 9) AS auc FROM s p, s n WHERE p.y = 1 AND n.y = 0")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_scored(spark, sf_dir)).withColumn("auc", F.round("auc", 9))


@register("SELECT (SELECT quality FROM labels GROUP BY quality ORDER BY count(*) DESC, quality LIMIT 1) AS majority, round((SELECT avg(quality) FROM labels), 9) AS p1")
def majority_baseline(spark, sf_dir):
    found = stats.majority(table(spark, sf_dir, "labels"), "quality")
    return found.withColumn("p1", F.round("p1", 9))


@register(f"""{STATS}, l AS (SELECT st.symbol, st.start_ts, st.end_ts, last_return, (SELECT arg_min(b.close, b.timestamp) FROM b WHERE b.symbol = st.symbol AND b.timestamp >= st.end_ts + 10800000) AS f, (SELECT arg_max(b.close, b.timestamp) FROM b WHERE b.symbol = st.symbol AND b.timestamp <= st.end_ts) AS n FROM st),
y AS (SELECT CASE WHEN f > n THEN 1 ELSE 0 END AS y, CASE WHEN last_return > 0 THEN 1 ELSE 0 END AS pred FROM l WHERE f > 0 AND n > 0), top AS (SELECT y AS m FROM y GROUP BY y ORDER BY count(*) DESC, y LIMIT 1)
SELECT 'persistence' AS baseline, round(avg(r), 9) AS balanced_accuracy FROM (SELECT avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END) AS r FROM y GROUP BY y) UNION ALL SELECT 'majority', round(avg(r), 9) FROM (SELECT avg(CASE WHEN y = m THEN 1.0 ELSE 0.0 END) AS r FROM y, top GROUP BY y)""")
def persistence_baseline(spark, sf_dir):
    from .plans.pipeline import labelled_windows

    rows = labelled_windows(hourly(spark, sf_dir), SPEC, 3 * HOUR)
    top = stats.majority(rows, "label").first()["majority"]
    return metrics.evaluate_task(rows, "label", top, True).withColumn("balanced_accuracy", F.round("balanced_accuracy", 9))


@register()
def kmeans_sizes(spark, sf_dir):
    found, _ = metrics.kmeans(table(spark, sf_dir, "embeddings"))
    return metrics.cluster_sizes(found)


@register()
def kmeans_silhouette(spark, sf_dir):
    found, _ = metrics.kmeans(table(spark, sf_dir, "embeddings"))
    return metrics.silhouette(found)


@register()
def logreg_probe(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") < 5).cast("int"))
    return metrics.probe(e.filter("vec_id % 4 <> 0"), e.filter("vec_id % 4 = 0"))


@register()
def pca_2d(spark, sf_dir):
    return metrics.pca(table(spark, sf_dir, "embeddings")).select("vec_id", "pca")


@register("""WITH e AS (SELECT vec_id, label AS c, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.vec_id, a.c, b.c AS c2, avg(list_distance(a.v, b.v)) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL),
s AS (SELECT vec_id, min(CASE WHEN c = c2 THEN d END) AS a, min(CASE WHEN c <> c2 THEN d END) AS b FROM d GROUP BY vec_id) SELECT round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) AS silhouette FROM s""")
def label_silhouette(spark, sf_dir):
    """Of the given labels, every vector against every other."""
    found = metrics.silhouette(table(spark, sf_dir, "embeddings").withColumnRenamed("label", "cluster"))
    return found.select(F.round("silhouette", 6).alias("silhouette"))


@register("SELECT count(*) AS vectors, CAST(8 AS BIGINT) AS clusters, true AS nearest FROM embeddings")
def kmeans_properties(spark, sf_dir):
    """Every vector is in one of eight clusters, and nearer to the mean of its own than to the other means, but for a few on borders
    that had not settled."""
    found, _ = metrics.kmeans(table(spark, sf_dir, "embeddings"))
    rows = found.select("vec_id", "cluster", V.doubles(F.col("embedding")).alias("v"))
    means = rows.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x")).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("m"))
    every = F.from_json(F.lit(means.agg(F.to_json(F.collect_list(F.struct("cluster", "m")))).first()[0]), "array<struct<cluster:int,m:array<double>>>")  # eight rows
    near = F.array_min(F.transform(every, lambda c: F.struct(V.distance(F.col("v"), c["m"]).alias("d"), c["cluster"].alias("cluster"))))["cluster"]
    return rows.agg(F.count("*").alias("vectors"), F.countDistinct("cluster").alias("clusters"), (F.avg((near == F.col("cluster")).cast("double")) > 0.9).alias("nearest"))


@register("SELECT count(*) AS vectors, true AS linear, true AS keeps_lengths FROM embeddings")
def projection_properties(spark, sf_dir):
    """The projection of a multiple is the multiple of the projection, and squared lengths stay as they are on average."""
    v = V.doubles(F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").select("embedding", V.gaussian_projection(v, 64).alias("p"), V.gaussian_projection(F.transform(v, lambda x: 3 * x), 64).alias("q"))
    apart = V.distance(F.transform("p", lambda x: 3 * x), F.col("q"))
    return rows.agg(F.count("*").alias("vectors"), (F.max(apart) < 1e-9).alias("linear"), F.avg(V.dot(F.col("p"), F.col("p")) / V.dot(v, v)).between(0.8, 1.2).alias("keeps_lengths"))


@register()
def random_projection(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.gaussian_projection(F.col("embedding"), 64).alias("projected"))


COSINE = "list_dot_product({0}, {1}) / ((sqrt(list_dot_product({0}, {0})) + 1e-8) * (sqrt(list_dot_product({1}, {1})) + 1e-8))"


@register(f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings), n AS (SELECT count(*) AS n FROM e),
d AS (SELECT t, ('0x' || substr(md5('0:' || t || ':a'), 1, 15))::BIGINT % n AS ia, ('0x' || substr(md5('0:' || t || ':b'), 1, 15))::BIGINT % n AS ib FROM (SELECT unnest(range(100000)) AS t), n),
f AS (SELECT {COSINE.format('a.v', 'b.v')} AS c FROM d JOIN e a ON a.i = ia JOIN e b ON b.i = ib WHERE ia <> ib AND a.label = b.label ORDER BY t LIMIT (SELECT least(10000, 10 * n) FROM n)),
g AS (SELECT {COSINE.format('v', 'w')} AS c FROM (SELECT v, label, lead(v) OVER o AS w, lead(label) OVER o AS other FROM e WINDOW o AS (ORDER BY vec_id)) WHERE label = other)
SELECT round((SELECT avg(c) FROM g), 6) AS adjacent_mean, round((SELECT stddev_pop(c) FROM g), 6) AS adjacent_std, round((SELECT avg(c) FROM f), 6) AS random_mean, round((SELECT avg(CASE WHEN g.c > f.c THEN 1.0 WHEN g.c = f.c THEN 0.5 ELSE 0.0 END) FROM f, g), 5) AS separation_auc""")
def temporal_consistency(spark, sf_dir):
    """Adjacent rows against random pairs of all rows, drawn by md5."""
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "symbol")
    found = metrics.temporal_consistency(e, ["vec_id"])
    return found.select(*[F.round(c, 5 if c == "separation_auc" else 6).alias(c) for c in found.columns])


@register()
def baseline_evaluation(spark, sf_dir):
    from .plans.pipeline import evaluate, labelled_windows
    from .storage import durable

    rows = durable(labelled_windows(hourly(spark, sf_dir), SPEC, 3 * HOUR))
    return evaluate(windows.split(rows, "train", BUDGET), windows.split(rows, "test", BUDGET))


def chance_sql(seed: int, *of: str) -> str:
    """sampling.chance in SQL."""
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(of)})), 1, 15))::BIGINT"


@register(f"{WINDOWS}, o AS (SELECT symbol, start_ts, row_number() OVER (ORDER BY {chance_sql(7, 'symbol', 'start_ts')}, symbol, start_ts) - 1 AS r FROM (SELECT symbol, start_ts FROM win)) SELECT symbol, start_ts, r // 32 AS batch FROM o WHERE r // 32 < (SELECT count(*) // 32 FROM o)")
def epoch_shuffle(spark, sf_dir):
    w = windows.window_starts(hourly(spark, sf_dir), SPEC)
    return sampling.batches(w, 32, [sampling.chance(7, "symbol", "start_ts"), "symbol", "start_ts"], drop_last=True).select("symbol", "start_ts", "batch")


@register(f"{WINDOWS} SELECT symbol, start_index, start_ts FROM (SELECT symbol, i AS start_index, start_ts, row_number() OVER (PARTITION BY symbol ORDER BY {chance_sql(0, 'start_ts')}, start_ts) AS r FROM win) WHERE r <= 20")
def window_subsample(spark, sf_dir):
    return sampling.subsample(windows.window_starts(hourly(spark, sf_dir), SPEC), 20, ["start_ts"], ["symbol"]).select("symbol", "start_index", "start_ts")


KEY = "symbol || '/' || start_ts"


@register(f"""{WINDOWS}, q AS (SELECT symbol, start_ts, unnest(range(8)) AS place FROM win), h AS (SELECT *, {chance_sql(0, KEY, 'place')} AS h FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, start_ts ORDER BY h) <= 3 AS picked FROM h),
m AS (SELECT symbol, start_ts, list(picked ORDER BY place) AS random_mask FROM r GROUP BY symbol, start_ts), z AS (SELECT symbol, start_ts, 0 + {chance_sql(0, KEY, '0')} % 3 AS a, 4 + {chance_sql(0, KEY, '1')} % 3 AS b FROM win)
SELECT symbol, start_ts, random_mask, list_transform(range(8), lambda p: p = a OR p = a + 1 OR p = b OR p = b + 1) AS span_mask FROM m JOIN z USING (symbol, start_ts)""")
def reconstruction_masks(spark, sf_dir):
    w = windows.window_starts(hourly(spark, sf_dir), SPEC)
    key = F.concat_ws("/", "symbol", F.col("start_ts").cast("string"))
    return w.select("symbol", "start_ts", sampling.random_mask(F.lit(8), 0.25, key).alias("random_mask"), sampling.span_mask(F.lit(8), 0.5, 2, key).alias("span_mask"))


@register(f"WITH {TICKS}, {bars_sql(HOUR)} SELECT * FROM b")
def stream_bars_available_now(spark, sf_dir):
    """The stream reads the events' file as it is, and gives every bar when all has been read."""
    from .plans.streams import available_now
    from .streaming.bars import stream_bars

    def shape(e: DataFrame) -> DataFrame:
        return e.select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("qty"))

    return available_now(spark, sf_dir, "events", lambda e: stream_bars(shape(e), "1 hour", None), "complete")


#: What streams of ticks need of events.
TICK_COLUMNS = ("event_id", "event_type", "ts", "value")
LATE = "(SELECT (max(epoch_us(ts)) // 1000 - 600000) * 1000 FROM events)"


@register(f"WITH e AS (SELECT event_type AS symbol, event_id AS id, epoch_us(ts) AS us, value FROM events), l AS (SELECT * FROM e WHERE id % 2 = 0 AND us < {LATE}), r AS (SELECT symbol, us AS rus, arg_max(value, id) AS value FROM e WHERE id % 2 = 1 GROUP BY symbol, us) SELECT l.symbol, l.id, us, rus AS match_us, r.value FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.us >= r.rus")
def stream_asof_available_now(spark, sf_dir):
    """Ticks of even ids as bars and those of odd ids as the sparse side, as one stream: what the watermark has passed."""
    from .plans.streams import available_now
    from .streaming.bars import stream_asof

    def shape(e: DataFrame) -> DataFrame:
        return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 2 == 0, "bar").otherwise("sparse").alias("side"), F.col("event_id").alias("id"), "value")

    found = available_now(spark, sf_dir, "events", lambda e: stream_asof(shape(e)), time="ts", columns=TICK_COLUMNS)
    return found.select("symbol", "id", F.unix_micros("ts").alias("us"), F.unix_micros("match_ts").alias("match_us"), "value")


@register(f"""WITH e AS (SELECT event_type AS symbol, event_id AS id, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms, value FROM events), g AS (SELECT *, row_number() OVER w - 1 AS i, lead(ms) OVER w - ms AS gap FROM e WINDOW w AS (PARTITION BY symbol ORDER BY us, id)),
x AS (SELECT symbol, i, ms AS start_ts, last_value(ms) OVER a AS end_ts, last_value(us) OVER a AS end_us, count(*) OVER a AS n, max(gap) OVER s AS max_gap, sum(value) OVER a AS total FROM g WINDOW a AS (PARTITION BY symbol ORDER BY us, id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), s AS (PARTITION BY symbol ORDER BY us, id ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING))
SELECT symbol, i AS start_index, start_ts, end_ts, round(total, 6) AS total FROM x WHERE n = 8 AND i % 4 = 0 AND max_gap <= {2 * HOUR} AND end_us < {LATE}""")
def stream_windows_available_now(spark, sf_dir):
    """Windows over the stream of all ticks: those whose last tick the watermark has passed."""
    from .plans.streams import available_now
    from .streaming.bars import stream_windows

    def shape(e: DataFrame) -> DataFrame:
        return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), "value")

    found = available_now(spark, sf_dir, "events", lambda e: stream_windows(shape(e), SPEC), time="ts", columns=TICK_COLUMNS)
    return found.select("symbol", "start_index", "start_ts", "end_ts", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def queries() -> dict[str, Query]:
    from . import record_queries, source_queries  # noqa: F401  these register their queries

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from . import record_queries, source_queries  # noqa: F401  these register their queries

    return dict(_sql)
