import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from barloom.plans import catalog, manifests
from barloom.sources import archives, canonical
from barloom.sources.calendar import calendar


def zipped(path, text):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.csv", text)


def test_zipped_bars_with_and_without_header(spark, tmp_path):
    row = "1700000000000000,1,2,0.5,1.5,10,1700000059999999,15,3,4,5,0"
    zipped(tmp_path / "a.zip", row + "\n")
    zipped(tmp_path / "b.zip", "open_time,open,high,low,close,volume,close_time,quote_volume,count,taker_buy_volume,taker_buy_quote_volume,ignore\n" + row.replace("000000,1,", "000,1,") + "\n")
    raw = archives.read_zipped_csv(spark, str(tmp_path / "*.zip"), "klines")
    got = archives.convert(raw, "klines").collect()
    assert {r.timestamp for r in got} == {1_700_000_000_000} and {r.close for r in got} == {1.5}
    assert {r.row_count for r in archives.summary(archives.convert(raw, "klines")).collect()} == {1}


def test_unknown_types_take_the_first_line_as_header(spark, tmp_path):
    zipped(tmp_path / "x.zip", "time,a\n2024-01-01 00:00:00,5\nnot a time,6\n")
    got = archives.convert(archives.read_zipped_csv(spark, str(tmp_path / "x.zip"), "other"), "other").collect()
    assert [(r.timestamp, r.a) for r in got] == [(1_704_067_200_000, 5.0)]


def test_nanoseconds(spark):
    frame = spark.createDataFrame([("f", 1_700_000_000_123_456_789)], "file string, timestamp long")
    assert archives.normalise_times(frame).first().timestamp == 1_700_000_000_123


def test_daily_frames_keep_the_first(spark):
    a = spark.createDataFrame([("A", 1, 1.0), ("A", None, 2.0)], "symbol string, timestamp long, open_interest double")
    b = spark.createDataFrame([("A", 1, 9.0), ("A", 2, 3.0)], "symbol string, timestamp long, open_interest double")
    assert sorted((r.timestamp, r.open_interest) for r in archives.consolidate_daily([a, b]).collect()) == [(1, 1.0), (2, 3.0)]


def test_asset_rows_and_urls(spark):
    doc = {"symbols": [{"symbol": "AB", "baseAsset": "A", "quoteAsset": "B", "status": "TRADING", "filters": [{"filterType": "PRICE_FILTER", "tickSize": "0.1"}, {"filterType": "LOT_SIZE", "stepSize": "0.01", "minQty": "0.02"}]}]}
    got = archives.asset_rows(spark.createDataFrame([(json.dumps(doc),)], "json string")).first()
    assert (got.tick_size, got.step_size, got.min_qty, got.is_active) == (0.1, 0.01, 0.02, True)
    url = spark.range(1).select(archives.archive_url("http://x", "futures", "klines", F.lit("AB"), F.lit(2024), F.lit(3)).alias("u")).first().u
    assert url == "http://x/futures/um/monthly/klines/AB/1m/AB-1m-2024-03.zip"


def test_fetch_skips_what_is_there(spark, tmp_path):
    (tmp_path / "b.zip").write_bytes(b"x")
    urls = spark.createDataFrame([("u/a.zip",), ("u/b.zip",), ("u/c.zip",)], "url string")
    got = archives.fetch(urls, str(tmp_path), lambda u: None if u.endswith("c.zip") else b"y")
    assert {r.url: r.status for r in got.collect()} == {"u/a.zip": "downloaded", "u/b.zip": "skipped", "u/c.zip": "absent"}


def test_calendar(spark):
    got = calendar(spark, 2024)
    assert got.count() == 527_040
    first = got.orderBy("timestamp").first()
    assert (first.day_of_week, first.is_weekend, first.minute_of_day, first.quarter) == (0, 0, 0, 1)


def test_canonical_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([("A", 1_704_067_200_000, 1.0), ("B", 1_706_745_600_000, 2.0)], "symbol string, timestamp long, close double")
    path = str(tmp_path / "t")
    canonical.write(canonical.with_provenance(frame, {"source": "test"}), path)
    got = canonical.read(spark, path, start_ms=1_706_000_000_000, symbol="B")
    assert [(r.close, r.month) for r in got.collect()] == [(2.0, 2)]
    assert canonical.provenance(got) == {"source": "test"}
    assert canonical.read(spark, str(tmp_path / "none*"), frame.schema).count() == 0
    assert canonical.exists(spark, path) and not canonical.exists(spark, str(tmp_path / "none*"))


def test_checksums(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    files = canonical.file_hashes(spark, str(tmp_path / "*.bin"))
    row = files.first()
    want = spark.createDataFrame([(row.path, "SHA256:".lower() + row.sha256.upper()), ("gone", "0")], "path string, sha256 string")
    assert {r.path: r.ok for r in canonical.checksum_matches(files, want).collect()} == {row.path: True, "gone": False}


def file_row(i, symbol="A", path="p", sha="s"):
    return (f"f{i}", "spot", symbol, "klines", "1m", 2024, 1, path, 0, 1, 10, 1 << 20, sha, "OK", "v1")


def test_file_catalogue(spark, tmp_path):
    table = catalog.Table(spark, str(tmp_path / "files"), catalog.FILES)
    assert table.read().count() == 0
    catalog.register_files(table, [file_row(1), file_row(2, "B", "q")])
    catalog.register_files(table, [file_row(1, sha="new")])
    assert {r.file_id: r.sha256 for r in table.read().collect()} == {"f1": "new", "f2": "s"}
    with pytest.raises(ValueError):
        catalog.register_files(table, [("short",)])
    assert catalog.query_files(table.read(), symbol="B", year=0).count() == 1
    assert catalog.cleanup_orphaned(table, spark.createDataFrame([("p",)], "path string")) == 1
    assert catalog.storage_summary(table.read()).first().total_mb == 1.0
    catalog.delete_file(table, "f1")
    assert table.read().count() == 0


def test_assets_and_experiments(spark, tmp_path):
    table = catalog.Table(spark, str(tmp_path / "assets"), catalog.ASSETS)
    row = spark.createDataFrame([("AB", "spot", "A", "B", 0.1, 0.1, 0.1, True)], "symbol string, market_type string, base_asset string, quote_asset string, tick_size double, step_size double, min_qty double, is_active boolean")
    catalog.register_assets(table, row)
    catalog.register_assets(table, row.withColumn("tick_size", F.lit(0.2)))
    assert table.read().count() == 2 and [r.tick_size for r in catalog.current_assets(table.read()).collect()] == [0.2]
    runs = catalog.Table(spark, str(tmp_path / "runs"), catalog.EXPERIMENTS)
    catalog.log_experiment(runs, {"experiment_id": "e", "metrics": {"a": 1}})
    with pytest.raises(ValueError):
        catalog.log_experiment(runs, {"experiment_id": "e"})
    assert catalog.experiments(runs).first().metrics == '{"a": 1}'


def test_manifests(spark, tmp_path):
    files = spark.createDataFrame([("f1", "A", "x"), ("f2", "C", "y")], "file_id string, symbol string, sha256 string")
    manifest = manifests.build_manifest("2024-01-01", ["A"], ["B"], ["A"], "2024-11-30", files=files)
    assert manifest["training_manifest"]["file_ledger"] == {"f1": "x"}
    a, b = manifests.fingerprint(manifest), manifests.fingerprint(json.loads(json.dumps(manifest)))
    assert a == b and a["file_count"] == 1
    where = manifests.create_snapshot(tmp_path, "s1", manifest, {"status": "none"})
    assert json.loads((where / "checksums.json").read_text()) == {"f1": "x"}
    with pytest.raises(FileExistsError):
        manifests.create_snapshot(tmp_path, "s1", manifest)
    manifests.record_stage(tmp_path / "l.json", "a", {"n": 1})
    assert len(manifests.record_stage(tmp_path / "l.json", "a", {"n": 2})["a"]) == 2
    assert "| f1 |" in manifests.markdown(files, "t") and len(manifests.cache_key({"a": 1})) == 20
    assert io.StringIO(manifests.data_card("c", manifest, files)).readline() == "# c\n"


def test_histories(spark):
    doc = json.dumps([{"symbol": "AB", "fundingTime": 5, "fundingRate": "0.1"}, {"symbol": "AB", "fundingTime": 6}])
    got = archives.history_rows(spark.createDataFrame([(doc,)], "json string"), "funding").collect()
    assert [(r.timestamp, r.funding_rate) for r in got] == [(5, 0.1), (6, None)]


def test_commands(spark, tmp_path):
    from barloom.__main__ import main

    bars = spark.range(600).select(F.lit("A").alias("symbol"), (F.col("id") * 60_000).alias("timestamp"), *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume")])
    bars.write.parquet(str(tmp_path / "bars"))
    assert main(["resample", str(tmp_path / "bars"), str(tmp_path / "hours")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "hours")).count() == 10
    assert main(["align", str(tmp_path / "bars"), str(tmp_path / "state"), "--end-ms", "5999999"], spark) == 0
    assert main(["windows", str(tmp_path / "state"), str(tmp_path / "w"), "--length", "50", "--stride", "25"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "w")).count() == 3
    assert main(["validate", str(tmp_path / "bars"), str(tmp_path / "v")], spark) == 0
    assert main(["report", str(tmp_path / "state"), str(tmp_path / "r")], spark) == 0
    assert main(["report", str(tmp_path / "none"), str(tmp_path / "r2")], spark) == 1


def test_old_versions_go_when_asked(spark, tmp_path):
    held = catalog.Table(spark, str(tmp_path / "t"), catalog.ASSETS)
    rows = spark.createDataFrame([("A", "spot")], "symbol string, market_type string")
    for _ in range(4):
        catalog.register_assets(held, rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in catalog.ASSETS if f.name != "valid_from"]))
    assert len(held.vacuum()) == 2 and held.vacuum() == [] and held.read().count() == 4
    assert [r.symbol for r in catalog.requested_assets(held.read(), ["A", "Z"]).collect()] == ["A"]


def test_experiments_are_logged_once(spark, tmp_path):
    held = catalog.Table(spark, str(tmp_path / "e"), catalog.EXPERIMENTS)
    two = spark.createDataFrame([("a", "{}"), ("b", None)], "experiment_id string, metrics string")
    catalog.log_experiments(held, two)
    for again in (two.limit(1), spark.createDataFrame([("c",), ("c",)], "experiment_id string")):
        with pytest.raises(ValueError, match="exist"):
            catalog.log_experiments(held, again)
    assert sorted(r.experiment_id for r in catalog.experiments(held).collect()) == ["a", "b"]


def test_fingerprint_of_a_ledger_that_stays_a_table(spark, monkeypatch):
    """The same as of a ledger on the driver, in many pieces, none of which is collected as rows of the ledger."""
    monkeypatch.setattr(manifests, "PIECE_FILES", 40)
    rows = [(f"{'é' if i % 7 == 0 else 'f'}\"{i}", "AB"[i % 2] if i % 5 else "C", f"{i:x}" if i % 11 else None) for i in range(500)]
    files = spark.createDataFrame(rows, "file_id string, symbol string, sha256 string")
    small = manifests.fingerprint(manifests.build_manifest("s", ["A"], ["B"], [], "2024-11-30", files=files))
    monkeypatch.setattr(manifests, "ledger", None)
    bare = manifests.build_manifest("s", ["A"], ["B"], [], "2024-11-30")
    assert manifests.fingerprint_of_table(bare, files) == small
    none = manifests.fingerprint_of_table(bare, files.filter("false"))
    assert none == manifests.fingerprint(bare)


def test_whole_pass_of_the_loader_is_of_many_tasks(spark):
    from barloom.plans.throughput import benchmark

    for n, tasks in ((1000, 7), (640, 4), (3, 3), (64, 1)):
        found = benchmark(spark.range(0, n, 1, tasks), 3, 64, None)
        assert (found["batches"], found["samples"]) == (-(-n // 64), n)


def test_loader_benchmark_reads_rows_in_the_tasks_that_hold_them(spark, sf, monkeypatch):
    from barloom import queries
    from barloom.plans import throughput

    seen, real = [], throughput.benchmark
    monkeypatch.setattr(throughput, "benchmark", lambda frame, *more: seen.append(frame._jdf.queryExecution().optimizedPlan().toString()) or real(frame, *more))
    queries.queries()["loader_benchmark"](spark, sf)
    assert len(seen) == 2 and "Repartition 1," not in seen[1]
