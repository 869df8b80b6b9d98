"""What the plans must and must not hold, whatever the data."""

import re

from pyspark.sql import functions as F

from barloom import queries
from barloom.config import WindowSpec
from barloom.operators import align, asof, ranks, resample, stats, windows
from barloom.sources import canonical


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_bars_are_one_shuffle_of_partial_sums(spark, sf):
    p = plan(resample.bars(queries.ticks(spark, sf), 3_600_000))
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1 and "Sort" not in p and "HashAggregate" in p and "partial_" in p


def test_scans_are_pruned_and_filtered(spark, tmp_path):
    rows = spark.range(10).select((F.col("id") * 1000).alias("timestamp"), F.lit(1.0).alias("close"), F.lit("x").alias("other"), F.lit("A").alias("symbol"))
    canonical.write(rows, str(tmp_path / "t"))
    p = plan(canonical.read(spark, str(tmp_path / "t"), start_ms=2000, end_ms=5000, symbol="A").select("timestamp", "close"))
    assert "GreaterThanOrEqual(timestamp,2000)" in p and "LessThanOrEqual(timestamp,5000)" in p and "PartitionFilters: [isnotnull(symbol" in p
    assert "ReadSchema: struct<timestamp:bigint,close:double>" in p


def test_asof_has_no_nested_loop_and_no_single_partition(spark):
    left = spark.range(10).select(F.lit("k").alias("symbol"), F.col("id").alias("timestamp"))
    right = left.withColumn("value", F.lit(1.0))
    p = plan(asof.asof(left, right, ["symbol"], ["value"]))
    assert "NestedLoop" not in p and "SinglePartition" not in p and "Python" not in p


def test_filling_reuses_the_partitions_of_matching(spark):
    bars = spark.range(10).select(F.lit("k").alias("symbol"), F.col("id").alias("timestamp"), F.lit(1.0).alias("close"))
    side = bars.select("symbol", "timestamp", F.col("close").alias("funding_rate"))
    found = asof.asof_filled(bars, {"funding_rate": side}, ["symbol"])
    found.collect()
    p = plan(found).split("== Initial Plan ==")[0]
    # The rows, and what the summaries need of them: one shuffle each, the second pass reading those of the first.
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning\(symbol#\d+, _slot#\d+L, \d+\), REPARTITION", p)) <= 3
    assert "ReusedExchange" in p and "NestedLoop" not in p


def test_range_filters_reach_the_events(spark, sf):
    p = plan(align.between(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id"), 5, 9, "user_id"))
    assert "GreaterThanOrEqual(user_id,5)" in p and "ReadSchema: struct<event_id:bigint,user_id:bigint>" in p


def test_exact_quantiles_are_counted_by_range(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 100).cast("double").alias("x"), F.when(F.col("id") > 996, F.col("id") * 1.0).alias("few"), F.lit(None).cast("double").alias("none"))
    found = ranks.order_statistics(rows, ["x", "few", "none"], [0.25, 0.5, 0.75])
    p = plan(found)
    assert "percentile" not in p and "SinglePartition" not in p
    got = {(r["column"], r.share): (r.n, r.disc, r.cont) for r in found.collect()}
    assert got[("x", 0.5)] == (1000, 49.0, 49.5) and got[("x", 0.25)] == (1000, 24.0, 24.75) and got[("few", 0.75)] == (3, 999.0, 998.5)
    assert not [k for k in got if k[0] == "none"]
    fit = {r["column"]: (r.median, r.iqr) for r in stats.robust_fit(rows, ["few", "none"]).collect()}
    assert fit == {"few": (998.0, 1.0), "none": (0.0, 1.0)}


def test_windows_gather_their_own_rows(spark):
    rows = spark.range(100).select(F.lit("k").alias("symbol"), (F.col("id") * 60_000).alias("timestamp"), F.array(F.col("id").cast("float")).alias("features"), F.array(F.lit(True)).alias("feature_mask"))
    spec = WindowSpec(length=5, stride=3)
    found = windows.create_windows(rows, spec)
    assert "collect_list" in plan(found) and "start_index" in re.search(r"ObjectHashAggregate\(keys=\[([^\]]*)\]", plan(found))[1]
    assert sorted([int(x[0]) for x in r.features] for r in found.collect()) == [list(range(i, i + 5)) for i in range(0, 96, 3)]


def test_medians_by_key_are_counted_by_range(spark):
    """A key with most rows, very many small ones and a null one; none has a task of its own."""
    import random
    from statistics import median

    rnd = random.Random(5)
    rows = [("big", float(rnd.randrange(500)), None) for _ in range(3000)] + [(rnd.choice([None, *map(str, range(300))]), rnd.random(), 1.0 * (i % 7)) for i in range(3000)] + [("none", None, None)]
    frame = spark.createDataFrame(rows, "symbol string, x double, y double")
    found = stats.thresholds(frame, ["x", "y"], ["symbol"])
    assert "percentile" not in plan(found) and "median" not in plan(found) and "SinglePartition" not in plan(found)

    def of(key, at):
        own = [r[at] for r in rows if r[0] == key and r[at] is not None]
        return median(own) if own else None

    assert {r.symbol: (r.x_threshold, r.y_threshold) for r in found.collect()} == {k: (of(k, 1), of(k, 2)) for k in {r[0] for r in rows}}
    assert found.count() == len({r[0] for r in rows})


def test_rows_are_numbered_without_one_task(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"))
    found = ranks.numbered(rows, "id")
    assert all(r.id == r._n for r in found.collect()) and found.count() == 1000
    assert plan(found).split("== Initial Plan ==")[-1].count("SinglePartition") == 1  # the slots' counts alone


def test_lags_run_in_slots_of_time(spark):
    rows = spark.range(50).select((F.col("id") % 1).cast("string").alias("symbol"), (F.col("id") * 7_000_000).alias("timestamp"), F.col("id"))
    found = asof.lagged(rows.withColumn("day", asof.time_slot(F.col("timestamp"))), ["symbol"], "day", [F.col("timestamp")], {"before": F.col("id")})
    assert sorted((r.id, r.before) for r in found.collect()) == [(i, i - 1 if i else None) for i in range(50)]
    assert re.search(r"hashpartitioning\(symbol#\d+, day#\d+L, ", plan(found)) and "SinglePartition" not in plan(found)


def test_market_state_has_no_nested_loop(spark, sf):
    assert "NestedLoop" not in plan(queries.queries()["market_state"](spark, sf)) and "Cartesian" not in plan(queries.queries()["market_state"](spark, sf))


def test_slots_follow_the_busiest_key(spark):
    day = 86_400_000
    rows = spark.range(4800).select(F.lit("busy").alias("symbol"), (F.col("id") * (day // 4800)).alias("timestamp")).unionByName(spark.range(9).select(F.lit("calm").alias("symbol"), (F.col("id") * day).alias("timestamp")))
    assert asof.slot_width(rows, keys=["symbol"], most=5000) == day
    assert asof.slot_width(rows, keys=["symbol"], most=1300) == day // 4
    assert asof.slot_width(rows, rows, keys=["symbol"], most=1300) == day // 8
    assert asof.slot_width(rows, keys=["symbol"], most=1) == day // 64
    assert asof.slot_width(rows.filter("timestamp < 0"), keys=["symbol"]) == day // 64
