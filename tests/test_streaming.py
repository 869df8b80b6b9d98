from pyspark.sql import functions as F

from barloom.config import WindowSpec
from barloom.streaming.bars import stream_asof, stream_sessions, stream_windows


def run(spark, frame, plan, tmp_path, batches):
    """Feeds one file for each batch; what an append stream has given in the end."""
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, frame).coalesce(1).write.parquet(str(folder / f"b{i}"))
    source = spark.readStream.schema(frame).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
    source = source.withColumn("ts", F.timestamp_millis("ms"))
    name = f"t{abs(hash(str(tmp_path)))}"
    query = plan(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_asof_gives_bars_once_the_watermark_has_passed(spark, tmp_path):
    minute = 60_000
    schema = "symbol string, side string, id long, ms long, value double"
    first = [("A", "bar", 1, 10 * minute, None), ("A", "sparse", 0, 5 * minute, 1.0), ("A", "sparse", 0, 12 * minute, 2.0), ("A", "bar", 2, 12 * minute, None)]
    later = [("A", "bar", 9, 100 * minute, None)]
    got = run(spark, schema, stream_asof, tmp_path, [first, later, [("A", "bar", 10, 200 * minute, None)]])
    assert {r.id: r.value for r in got if r.id < 3} == {1: 1.0, 2: 2.0}


def test_sessions(spark, tmp_path):
    minute = 60_000
    schema = "symbol string, ms long"
    got = run(spark, schema, lambda s: stream_sessions(s, "5 minutes", "1 minute"), tmp_path, [[("A", 0), ("A", 2 * minute), ("A", 20 * minute)], [("A", 200 * minute)]])
    assert sorted(r.n_rows for r in got) == [1, 2]


def test_windows_are_given_once_and_as_from_a_table(spark, tmp_path):
    """Rows out of order within batches, a gap, and windows that span batches; the last rows are still open."""
    minute = 60_000
    times = [10**6 + t for t in (*range(0, 20), *range(40, 60), 200)]
    rows = [("A", i, t * minute, float(i)) for i, t in enumerate(times)] + [("B", 99, times[5] * minute, None)]
    batches = [rows[:9][::-1] + rows[-1:], rows[9:25], rows[25:-2], rows[-2:-1]]
    spec = WindowSpec(length=4, stride=3, max_gap_ms=5 * minute)
    got = run(spark, "symbol string, id long, ms long, value double", lambda s: stream_windows(s, spec, late="30 minutes"), tmp_path, batches)
    want = [(i, times[i] * minute, times[i + 3] * minute, [float(j) for j in range(i, i + 4)]) for i in range(0, 37, 3) if all(times[j + 1] - times[j] <= 5 for j in range(i, i + 3))]
    assert sorted((r.start_index, r.start_ts, r.end_ts, r["values"]) for r in got) == want and len(want) == 12


def test_a_table_is_fed_in_batches_in_the_order_of_time(spark, duck, sf, monkeypatch):
    """In many batches the same comes out as SQL has of the whole table, and no batch has more rows than are asked for."""
    from helpers import canonical

    from barloom import queries
    from barloom.plans import streams

    monkeypatch.setattr(streams, "FEED_ROWS", 250)
    fed, real = [], streams.in_time_order
    monkeypatch.setattr(streams, "in_time_order", lambda *args: fed.append(real(*args)) or fed[-1])
    for name in ("stream_asof_available_now", "stream_windows_available_now"):
        got = [r.asDict() for r in queries.queries()[name](spark, sf).collect()]
        cursor = duck.execute(queries.oracle_sql()[name])
        columns = [c[0] for c in cursor.description]
        assert canonical(got) == canonical([dict(zip(columns, r, strict=True)) for r in cursor.fetchall()])
    assert fed == [4, 4]


def test_a_stream_has_the_asked_columns_in_large_arrow_batches(spark, tmp_path):
    """Spark sends a key's state along with each Arrow batch of its rows; with batches of 10,000 rows that grew as the square of them."""
    from barloom.plans import streams

    spark.range(30_000).select(F.timestamp_millis("id").alias("ts"), "id", F.lit("x").alias("more")).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    arrow = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(arrow)

    def sizes(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame({"n": [len(frame)], "columns": [",".join(frame.columns)]})

    found = streams.available_now(spark, str(tmp_path), "t", lambda s: s.mapInPandas(sizes, "n long, columns string"), time="ts", columns=("ts", "id"))
    assert [tuple(r) for r in found.collect()] == [(30_000, "ts,id")] and spark.conf.get(arrow) == before


def test_asof_leaves_out_rows_without_a_time(spark, tmp_path):
    minute = 60_000
    rows = [("A", "sparse", 0, None, 9.0), ("A", "bar", 5, None, None), ("A", "bar", 1, 10 * minute, None), ("A", "sparse", 2, 11 * minute, None), ("A", "bar", 3, 11 * minute, None)]
    got = run(spark, "symbol string, side string, id long, ms long, value double", stream_asof, tmp_path, [rows, [("A", "bar", 6, 100 * minute, None)]])
    assert sorted((r.id, r.match_ts is None, r.value) for r in got) == [(1, True, None), (3, False, None)]


def test_windows_leave_out_rows_without_a_time(spark, tmp_path):
    minute = 60_000
    rows = [("A", 0, None, 9.0)] + [("A", i, i * minute, float(i)) for i in range(1, 7)]
    spec = WindowSpec(length=2, stride=2, max_gap_ms=5 * minute)
    got = run(spark, "symbol string, id long, ms long, value double", lambda s: stream_windows(s, spec), tmp_path, [rows, [("A", 9, 100 * minute, 1.0)]])
    assert sorted((r.start_index, r["values"]) for r in got) == [(0, [1.0, 2.0]), (2, [3.0, 4.0]), (4, [5.0, 6.0])]


def test_a_batch_of_bounded_size_has_few_tasks(spark, sf, tmp_path, monkeypatch):
    """Each task of a batch starts a worker and keeps a state; the session's number of partitions, for whole tables, made most of them idle."""
    from barloom import queries
    from barloom.plans import streams

    monkeypatch.setattr(streams, "fresh_dir", lambda *_: str(tmp_path / "stream"))
    partitions = "spark.sql.shuffle.partitions"
    before = spark.conf.get(partitions)
    spark.conf.set(partitions, "40")
    try:
        assert queries.queries()["stream_asof_available_now"](spark, sf).count() > 0
        assert len([p for p in (tmp_path / "stream-state" / "state" / "0").iterdir() if p.name.isdigit()]) == 16
        assert spark.conf.get(partitions) == "40"
    finally:
        spark.conf.set(partitions, before)
