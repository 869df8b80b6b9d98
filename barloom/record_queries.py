"""The query catalogue's records: documents of exchanges, downloads, fitted state, snapshots, lineage, reports and registers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import ValidationRules
from .functions.time import frequency_ms
from .operators import quality, stats
from .plans import catalog, manifests
from .plans.files import get_text, put_text
from .queries import HOUR, TICKS, _files, bars_sql, hourly, register, table, ticks
from .sources import archives
from .storage import fresh_dir

#: Entries of a document, as a page of an exchange's answer has.
PAGE = 50


@register("SELECT 'P' || p_partkey AS symbol, p_brand AS base_asset, p_type AS quote_asset, CASE WHEN p_partkey % 7 > 0 THEN p_size / 100.0 END AS tick_size, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_size AS DOUBLE) END AS step_size, CASE WHEN p_partkey % 5 > 0 THEN CAST(2 * p_size AS DOUBLE) END AS min_qty, p_size > 25 AS is_active FROM part")
def exchange_assets(spark, sf_dir):
    """Parts as symbols in an exchange's documents, a page of them in each; some lack a filter, others have a number that is none."""
    size, key = F.col("p_size"), F.col("p_partkey")
    price = F.create_map(F.lit("filterType"), F.lit("PRICE_FILTER"), F.lit("tickSize"), F.when(key % 7 > 0, (size / 100.0).cast("string")).otherwise("none"))
    lot = F.create_map(F.lit("filterType"), F.lit("LOT_SIZE"), F.lit("stepSize"), size.cast("string"), F.lit("minQty"), (2 * size).cast("string"))
    filters = F.when(key % 5 > 0, F.array(price, lot)).otherwise(F.array(price))
    entry = F.struct(F.concat(F.lit("P"), key.cast("string")).alias("symbol"), F.col("p_brand").alias("baseAsset"), F.col("p_type").alias("quoteAsset"), F.when(size > 25, "TRADING").otherwise("BREAK").alias("status"), filters.alias("filters"))
    pages = table(spark, sf_dir, "part").groupBy(F.floor(key / PAGE).alias("page")).agg(F.to_json(F.struct(F.collect_list(entry).alias("symbols"))).alias("json"))
    return archives.asset_rows(pages)


@register(f"WITH {TICKS} SELECT kind, symbol, timestamp, CASE WHEN event_id % 11 > 0 THEN round(price, 9) END AS value FROM t, (VALUES ('funding'), ('open_interest')) k(kind)")
def exchange_history(spark, sf_dir):
    """Ticks as entries of past funding rates and of open interest, in pages of documents; some values are no numbers."""
    value = F.when(F.col("event_id") % 11 > 0, F.col("price").cast("string")).otherwise("")

    def parsed(kind: str, time: str, number: str, column: str) -> DataFrame:
        entry = F.struct("symbol", F.col("timestamp").alias(time), value.alias(number))
        pages = ticks(spark, sf_dir).groupBy(F.floor(F.col("event_id") / PAGE).alias("page")).agg(F.to_json(F.collect_list(entry)).alias("json"))
        return archives.history_rows(pages, kind).select(F.lit(kind).alias("kind"), "symbol", "timestamp", F.round(column, 9).alias("value"))

    return parsed("funding", "fundingTime", "fundingRate", "funding_rate").unionByName(parsed("open_interest", "timestamp", "sumOpenInterest", "open_interest"))


def _answer(url: str) -> bytes | None:
    """What a site has under a URL: nothing of every month's fifth day."""
    return None if url.endswith("-05.zip") else url.encode()


@register(f"WITH {TICKS}, d AS (SELECT DISTINCT symbol, CAST(epoch_ms(timestamp) AS DATE) AS day FROM t), u AS (SELECT 'https://site/data/futures/um/daily/aggTrades/' || symbol || '/' || symbol || '-aggTrades-' || CAST(day AS VARCHAR) || '.zip' AS url, day FROM d) SELECT url, pass, CASE WHEN day(day) = 5 THEN 'absent' WHEN pass = 1 THEN 'downloaded' ELSE 'skipped' END AS status, CASE WHEN day(day) <> 5 THEN sha256(url) END AS sha256 FROM u, (VALUES (1), (2)) p(pass)")
def downloads(spark, sf_dir):
    """An archive for each symbol and day of ticks is fetched, and once more; what was fetched is read back as files."""
    day = F.timestamp_millis("timestamp")
    days = ticks(spark, sf_dir).select("symbol", F.year(day).alias("y"), F.month(day).alias("m"), F.dayofmonth(day).alias("d")).distinct()
    urls = days.select(archives.archive_url("https://site/data", "futures", "aggTrades", F.col("symbol"), F.col("y"), F.col("m"), day=F.col("d")).alias("url")).repartition(4, "url")
    folder, done = fresh_dir(spark, "downloads"), fresh_dir(spark, "downloaded")
    for i in (1, 2):
        archives.fetch(urls, folder, _answer).write.parquet(f"{done}/pass={i}")
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("name")
    held = spark.read.format("binaryFile").load(f"{folder}/*.zip").select(name, F.sha2("content", 256).alias("sha256"))
    found = spark.read.parquet(done).select("url", F.col("pass").cast("int").alias("pass"), "status", name)
    return found.join(held, "name", "left").select("url", "pass", "status", "sha256")


@register("SELECT l_orderkey, l_linenumber, round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_samp(l_extendedprice) FROM lineitem), 6) AS l_extendedprice, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_samp(l_quantity) FROM lineitem), 6) AS l_quantity FROM lineitem")
def restored_scaler(spark, sf_dir):
    """A scaler that was fitted, written as a document, read back and applied."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in ("l_extendedprice", "l_quantity")])
    at = f"{fresh_dir(spark, 'scaler')}/scaler.json"
    put_text(spark, at, stats.Normalizer("zscore").fit(rows, ["l_extendedprice", "l_quantity"]).dumps())
    found = stats.Normalizer.loads(get_text(spark, at)).transform(rows)
    return found.withColumns({c: F.round(c, 6) for c in ("l_extendedprice", "l_quantity")})


def _daily_files(spark, sf_dir) -> DataFrame:
    """A file for each symbol and day of ticks, its digest that of their number."""
    day = F.date_format(F.timestamp_millis("timestamp"), "yyyy-MM-dd")
    files = ticks(spark, sf_dir).groupBy("symbol", day.alias("day")).agg(F.count("*").alias("row_count"))
    return files.select("symbol", F.concat_ws("-", "symbol", "day").alias("file_id"), "row_count", F.sha2(F.col("row_count").cast("string"), 256).alias("sha256"))


@register(f"""WITH {TICKS}, f AS (SELECT symbol || '-' || CAST(CAST(epoch_ms(timestamp) AS DATE) AS VARCHAR) AS file_id, sha256(CAST(count(*) AS VARCHAR)) AS sha, count(*) AS n FROM t WHERE symbol IN ('click', 'view') GROUP BY symbol, CAST(epoch_ms(timestamp) AS DATE)),
l AS (SELECT '{{' || string_agg('"' || file_id || '": "' || sha || '"', ', ' ORDER BY file_id) || '}}' AS ledger, count(*) AS files, CAST(sum(n) AS BIGINT) AS total FROM f)
SELECT files, total AS row_count, sha256('{{"checksums": ' || ledger || ', "manifest": {{"training_manifest": {{"dataset": {{"alignment_version": "alignment_v1.yaml", "canonical_schema_version": "v1", "feature_builder_version": "v1", "market_state_schema_version": "v1", "modality_registry": "modalities_v1.yaml", "snapshot": "s1", "windowing_version": "windowing_v1.yaml"}}, "file_ledger": ' || ledger ||
 ', "random_seed": {{"numpy": 42, "python": 42, "torch": 42}}, "splits": {{"test": {{"symbols": []}}, "time_split": {{"train_end": "2024-01-15"}}, "train": {{"symbols": ["click"]}}, "validation": {{"symbols": ["click", "view"]}}}}}}}}, "statistics": {{"row_count": ' || total || '}}}}') AS sha256, true AS immutable FROM l""")
def snapshot_contents(spark, sf_dir):
    """A snapshot of two symbols' daily files as read back, and that its name cannot be taken again. A symbol of two splits counts once."""
    files = _daily_files(spark, sf_dir)
    manifest = manifests.build_manifest("s1", ["click"], ["click", "view"], [], "2024-01-15", files=files)
    rows = files.filter("symbol IN ('click', 'view')").agg(F.sum("row_count")).first()[0]
    folder = fresh_dir(spark, "snapshots")
    at = manifests.create_snapshot(folder, "s1", manifest, {"status": "none"}, {"row_count": rows}, spark)
    try:
        manifests.create_snapshot(folder, "s1", manifest, spark=spark)
        immutable = False
    except FileExistsError:
        immutable = True
    checksums, statistics, own = (manifests.load_json(f"{at}/{part}.json", spark) for part in ("checksums", "statistics", "snapshot"))
    return spark.createDataFrame([(len(checksums), statistics["row_count"], own["sha256"], immutable)], "files long, row_count long, sha256 string, immutable boolean")


@register(f"WITH {TICKS}, {bars_sql(HOUR)} SELECT 'ticks' AS stage, CAST(0 AS BIGINT) AS entry, count(*) AS row_count FROM t UNION ALL SELECT 'bars', 0, count(*) FROM b UNION ALL SELECT 'bars', 1, count(*) FROM b WHERE constituent_count > 1")
def stage_lineage(spark, sf_dir):
    """Stages and their rows, recorded one after another in a document and read back."""
    at = f"{fresh_dir(spark, 'lineage')}/lineage.json"
    b = hourly(spark, sf_dir)
    for stage, rows in (("ticks", ticks(spark, sf_dir)), ("bars", b), ("bars", b.filter("constituent_count > 1"))):
        manifests.record_stage(at, stage, {"row_count": rows.count()}, spark)
    text = spark.read.text(at, wholetext=True)
    kept = F.from_json("value", "map<string, array<struct<recorded_at: timestamp, row_count: long>>>")
    return text.select(F.explode(kept).alias("stage", "held")).select("stage", F.posexplode("held").alias("entry", "e")).filter("e.recorded_at IS NOT NULL").select("stage", F.col("entry").cast("long").alias("entry"), "e.row_count")


@register("SELECT o_orderpriority AS dataset, 'v' || min(year(o_orderdate)) AS version, count(*) AS file_count, CAST(sum(o_custkey) AS BIGINT) AS total_rows, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total_bytes FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1")
def dataset_versions(spark, sf_dir):
    """Versions of two datasets of the catalogue, as documents."""
    files, rows = _files(spark, sf_dir), []
    for name in ("1-URGENT", "5-LOW"):
        own = files.filter(F.col("dataset_type") == name)
        rows.append(manifests.dataset_version(name, f"v{own.agg(F.min('year')).first()[0]}", own))
    return spark.createDataFrame([tuple(r[c] for c in ("dataset", "version", "file_count", "total_rows", "total_bytes")) for r in rows], "dataset string, version string, file_count long, total_rows long, total_bytes long")


@register("""WITH s AS (SELECT o_orderpriority AS p, format('{:,}', count(*)) AS n, format('{:,}', CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT)) AS b FROM orders GROUP BY 1), l AS (SELECT 4 + row_number() OVER (ORDER BY p) AS line, '| ' || p || ' | ' || n || ' | ' || b || ' |' AS text FROM s)
SELECT CAST(line AS BIGINT) AS line, text FROM l UNION ALL SELECT unnest([1, 2, 3, 4]), unnest(['# Storage', '', '| dataset_type | file_count | total_bytes |', '| --- | --- | --- |'])""")
def markdown_report(spark, sf_dir):
    """The catalogue's summary as the lines of a Markdown file, read back."""
    at = f"{fresh_dir(spark, 'report')}/storage.md"
    summary = catalog.storage_summary(_files(spark, sf_dir), ("dataset_type",)).select("dataset_type", "file_count", "total_bytes").orderBy("dataset_type")
    put_text(spark, at, manifests.markdown(summary, "Storage"))
    lines = F.split(F.rtrim("value", F.lit("\n")), "\n")
    return spark.read.text(at, wholetext=True).select(F.posexplode(lines).alias("line", "text")).select((F.col("line") + 1).cast("long").alias("line"), "text")


@register("SELECT file_id, row_count FROM (SELECT 'f' || (o_orderkey // 3) AS file_id, o_orderkey // 3 AS k, o_custkey AS row_count FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey // 3 ORDER BY o_orderkey % 2 DESC, o_orderdate DESC, o_orderkey DESC) = 1) WHERE k % 4 <> 0 AND k <> (SELECT min(o_orderkey // 3) FROM orders WHERE (o_orderkey // 3) % 4 <> 0)")
def register_lifecycle(spark, sf_dir):
    """A register written in two goes, a batch of wrong width that changes nothing, a deleted file, and those whose path is gone."""
    held = catalog.Table(spark, fresh_dir(spark, "register"), catalog.FILES)
    group = F.floor(F.col("o_orderkey") / 3)
    files = _files(spark, sf_dir).withColumn("path", F.concat(F.lit("p"), group.cast("string")))
    shaped = [(F.col(f.name) if f.name in files.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in catalog.FILES]
    for odd in (0, 1):
        own = files.filter(F.col("o_orderkey") % 2 == odd)
        newest = catalog.latest(own, ["file_id"], [F.desc("created_at"), F.desc("o_orderkey")])
        catalog.register_files(held, newest.select(*shaped))
    before = held.version()
    try:
        catalog.register_files(held, [("f0", "spot")])
    except ValueError:
        if held.version() != before:
            raise RuntimeError("a refused batch was written") from None
    else:
        raise RuntimeError("a batch of wrong width was written")
    kept = files.filter(F.pmod(group, F.lit(4)) != 0)
    catalog.delete_file(held, f"f{kept.agg(F.min(group)).first()[0]}")
    catalog.cleanup_orphaned(held, kept.select("path"))
    held.vacuum(1)
    return held.read().select("file_id", "row_count")


@register(f"WITH {TICKS}, {bars_sql(HOUR)} SELECT 'on' AS rules, 'high_gte_low' AS rule, count(CASE WHEN low * 1.5 < low + high - open THEN 1 END) AS bad_count FROM b UNION ALL SELECT 'on', 'close_positive', count(CASE WHEN close - 5 <= 0 THEN 1 END) FROM b UNION ALL SELECT 'off', 'close_positive', count(CASE WHEN close - 5 <= 0 THEN 1 END) FROM b")
def rules_switched(spark, sf_dir):
    """Broken bars under rules that are all on, and with one switched off by a setting."""
    b = hourly(spark, sf_dir).select((F.col("low") * 1.5).alias("high"), (F.col("low") + F.col("high") - F.col("open")).alias("low"), (F.col("close") - 5).alias("close"))
    off = ValidationRules(modalities={"klines": {"high_gte_low": False}})
    parts = [quality.rule_counts(b, "klines", rules).select(F.lit(name).alias("rules"), "rule", "bad_count") for name, rules in (("on", ValidationRules()), ("off", off))]
    return parts[0].unionByName(parts[1])


@register("SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 1000 WHEN 1 THEN 60000 WHEN 2 THEN 3600000 WHEN 3 THEN 86400000 ELSE 0 END * (o_custkey % 90) AS ms FROM orders")
def frequencies(spark, sf_dir):
    """Texts of frequencies, with a few forms that are none."""
    unit = F.element_at(F.array(*map(F.lit, ("s", " m ", "h", "d", "w", "", "mh"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", frequency_ms(F.concat((F.col("o_custkey") % 90).cast("string"), unit)).alias("ms"))
