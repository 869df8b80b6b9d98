import pytest
from pyspark.sql import functions as F

from barloom.config import FUNDING, OPEN_INTEREST, WindowSpec, active_modalities, frequency_ms
from barloom.operators import align, asof, features, resample, windows

MINUTE = 60_000
START = 1_700_000_000_000 - 1_700_000_000_000 % MINUTE


def flat_bars(spark, n, symbol="A"):
    return spark.range(n).select(F.lit(symbol).alias("symbol"), (F.lit(START) + F.col("id") * MINUTE).alias("timestamp"), F.lit(100.0).alias("open"), F.lit(101.0).alias("high"), F.lit(99.0).alias("low"), F.lit(100.5).alias("close"), F.lit(10.0).alias("volume"))


def test_resample_five_minutes(spark):
    rows = [("A", i * MINUTE, 100.0 + i, 104.0 + i, 98.0 + i, 103.0 + i, 20.0) for i in range(5)]
    frame = spark.createDataFrame(rows, "symbol string, timestamp long, open double, high double, low double, close double, volume double")
    got = resample.resample(frame, "5m").first()
    assert (got.open, got.high, got.low, got.close, got.volume, got.constituent_count) == (100.0, 108.0, 98.0, 107.0, 100.0, 5)
    assert got.close_time == 5 * MINUTE - 1 and got.complete and got.status == "RESAMPLED"
    part = resample.resample(frame.limit(2), "5m").first()
    assert part.constituent_count == 2 and part.status == "RESAMPLED_INCOMPLETE"
    with pytest.raises(ValueError):
        resample.resample(frame, "7m")
    assert resample.resample(frame.filter("false"), "5m").count() == 0


@pytest.mark.parametrize("slot", [1, 7, 10**9])
def test_asof_is_the_same_whatever_the_slots(spark, slot):
    import random

    rnd = random.Random(slot)
    left = [("k", i, rnd.randrange(200)) for i in range(120)] + [("m", 500, 5), ("k", 501, None)]
    right = [("k", rnd.randrange(200), i, None if i % 4 == 0 else float(i)) for i in range(40)]
    a = spark.createDataFrame(left, "symbol string, id long, timestamp long")
    b = spark.createDataFrame([*right, ("k", None, 99, 9.0)], "symbol string, timestamp long, tie long, value double")

    def best(k, t, direction, strict):
        sign = 1 if direction == "backward" else -1
        held = [(sign * rt, tie, rt, v) for s, rt, tie, v in right if s == k and t is not None and (sign * rt < sign * t if strict else sign * rt <= sign * t)]
        return max(held, key=lambda r: r[:2])[2:] if held else (None, None)

    for direction in ("backward", "forward"):
        for strict in (False, True):
            found = asof.asof(a, b, ["symbol"], ["value"], tie="tie", direction=direction, strict=strict, slot_ms=slot)
            got = {r.id: (r.match_timestamp, r.value) for r in found.collect()}
            assert got == {i: best(k, t, direction, strict) for k, i, t in left}


def test_ages_count_from_the_matched_row_even_if_null(spark):
    bars = flat_bars(spark, 10).withColumn("close_time", F.col("timestamp"))
    funding = spark.createDataFrame([("A", START, 0.5), ("A", START + 4 * MINUTE, None)], "symbol string, settlement_time long, funding_rate double")
    got = align.market_state(bars, funding).orderBy("timestamp").collect()
    assert [r.funding_rate for r in got] == [0.5] * 10
    assert not any(r.funding_rate_stale for r in got)
    assert all(r.open_interest is None and r.open_interest_stale is False for r in got)


def test_staleness_limits(spark):
    bars = flat_bars(spark, 600).withColumn("close_time", F.col("timestamp"))
    funding = spark.createDataFrame([("A", START + 60 * MINUTE, 0.1)], "symbol string, settlement_time long, funding_rate double")
    stale = [r.funding_rate_stale for r in align.join_sparse(align.known_at(bars), {FUNDING: funding}).orderBy("timestamp").collect()]
    assert stale == [not 60 <= i <= 540 for i in range(600)]
    interest = spark.createDataFrame([("A", START, 7.0)], "symbol string, timestamp long, open_interest double")
    stale = [r.open_interest_stale for r in align.join_sparse(align.known_at(flat_bars(spark, 60).withColumn("close_time", F.col("timestamp"))), {OPEN_INTEREST: interest}).orderBy("timestamp").collect()]
    assert stale == [i > 5 for i in range(60)]


def test_a_later_row_changes_nothing_before_it(spark):
    bars = flat_bars(spark, 60)
    one = spark.createDataFrame([("A", START, 0.1), ("A", START + 30 * MINUTE, 0.2)], "symbol string, settlement_time long, funding_rate double")
    other = spark.createDataFrame([("A", START, 0.1), ("A", START + 30 * MINUTE, 0.9)], "symbol string, settlement_time long, funding_rate double")
    before = F.col("timestamp") < START + 30 * MINUTE
    a, b = (align.market_state(bars, f).filter(before).select("timestamp", "funding_rate") for f in (one, other))
    assert a.exceptAll(b).isEmpty() and b.count() == 30


def test_known_at_without_closing_times(spark):
    assert align.known_at(flat_bars(spark, 3)).agg(F.min("timestamp")).first()[0] == START + MINUTE - 1
    with pytest.raises(KeyError):
        align.known_at(flat_bars(spark, 3).drop("timestamp"))
    with pytest.raises(ValueError):
        align.market_state(flat_bars(spark, 3), depth=flat_bars(spark, 1))
    with pytest.raises(KeyError):
        align.sparse(flat_bars(spark, 1), FUNDING)


def test_features_mask_what_is_missing_stale_or_not_finite(spark):
    rows = [("A", 0, 1.0, None, True), ("A", 1, float("nan"), 2.0, False), ("A", 2, float("inf"), 2.0, True)]
    state = spark.createDataFrame(rows, "symbol string, timestamp long, close double, funding_rate double, funding_rate_stale boolean")
    got = features.raw_features(state, order=("close", "funding_rate", "absent")).orderBy("timestamp").collect()
    assert [r.feature_mask for r in got] == [[True, False, False], [False, True, False], [False, False, False]]
    assert got[1].features == [0.0, 2.0, 0.0]
    with pytest.raises(ValueError):
        features.raw_features(state, dimension=3)


def test_returns(spark):
    rows = [("A", i, c, c, c, c, v) for i, (c, v) in enumerate([(1.0, 0.0), (2.0, -5.0), (0.0, 1.0), (3.0, None)])]
    state = spark.createDataFrame(rows, "symbol string, timestamp long, open double, high double, low double, close double, volume double")
    got = features.return_features(state).orderBy("timestamp").collect()
    assert [r.feature_mask[0] for r in got] == [False, True, False, False]
    assert [r.feature_mask[3] for r in got] == [True, True, True, False]
    assert abs(got[1].features[0] - 0.6931) < 1e-3


def test_windows(spark):
    frame = features.raw_features(flat_bars(spark, 10).select("symbol", "timestamp", "close"), order=("close",))
    got = windows.create_windows(frame, WindowSpec(5, 1)).collect()
    assert len(got) == 6 and all(len(r.features) == 5 and r.mask == [True] * 5 and r.metadata.contiguous for r in got)
    assert windows.max_position(windows.create_windows(frame, WindowSpec(5, 1))).first()[0] == 5


def test_windows_skip_gaps_and_are_not_rebased(spark):
    late = (F.col("timestamp") >= START + 5 * MINUTE).cast("long") * 300_000
    frame = flat_bars(spark, 10).withColumn("timestamp", F.col("timestamp") + late)
    assert windows.window_starts(frame, WindowSpec(5, 1, 300_000)).count() == 2
    assert windows.window_starts(frame, WindowSpec(5, 1, 360_000)).count() == 6
    assert [r.start_index for r in windows.window_starts(frame, WindowSpec(3, 2, 300_000)).orderBy("start_index").collect()] == [0, 2, 6]
    assert windows.window_starts(frame, WindowSpec(1, 4)).count() == 3


def test_position_mask_flags_wide_gaps(spark):
    times = [0, MINUTE, 2 * MINUTE, 7 * MINUTE, 8 * MINUTE, 9 * MINUTE]
    frame = spark.createDataFrame([("A", t, [1.0], [True]) for t in times], "symbol string, timestamp long, features array<double>, feature_mask array<boolean>")
    assert windows.create_windows(frame, WindowSpec(6, 1)).first().mask == [True, True, False, True, True, True]


def test_repeated_times_are_an_error(spark):
    frame = flat_bars(spark, 4)
    windows.check_increasing(frame)
    with pytest.raises(ValueError, match="non-positive delta"):
        windows.check_increasing(frame.unionByName(frame.limit(1)))


def test_labels_do_not_look_past_the_budget(spark):
    closes = spark.createDataFrame([("A", i * MINUTE, float(i % 3)) for i in range(10)], "symbol string, timestamp long, close double")
    ends = closes.select("symbol", F.col("timestamp").alias("end_ts"))
    got = windows.future_labels(ends, closes, 2 * MINUTE, 6 * MINUTE, positive_only=False).orderBy("end_ts").collect()
    assert [r.end_ts // MINUTE for r in got] == [0, 1, 2, 3, 4]
    assert [r.label for r in got] == [0, 0, 0, 0, 0] and windows.future_labels(ends, closes, MINUTE).count() == 3


def test_settings():
    assert [frequency_ms(x) for x in ("8h", "5m", "30s", "variable", None)] == [28_800_000, 300_000, 30_000, 0, 0]
    assert active_modalities({"a": {"enabled": True}, "b": {"enabled": False}}) == ["a"]
    with pytest.raises(ValueError):
        active_modalities({"a": {}})
    with pytest.raises(TypeError):
        active_modalities({"a": {"enabled": "yes"}})
