"""More of the query catalogue: sources, rules, catalogue and metrics over the provided tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import vectors as V
from .operators import align, features, metrics, quality, sampling, stats, windows
from .operators.ranks import numbered
from .plans import catalog
from .queries import _windows as volume_windows
from .queries import BUDGET, HOUR, LINE, NORMS, SCORED, SPEC, STATE, TICKS, WINDOWS, _files, _scored, _state, bars_sql, hourly, register, table, ticks
from .sources import archives, canonical
from .storage import fresh_dir

BARS = ("open", "high", "low", "close", "volume")
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in BARS)


def _zipped(bars: DataFrame, folder: str) -> None:
    """An archive of headed or headless CSV for each symbol and day, its times in microseconds on odd days."""

    def pack(frame):
        import io
        import zipfile

        import pandas as pd
        from pyarrow import fs

        odd = int(frame["day"].iloc[0]) % 2 == 1
        rows = pd.DataFrame({c: frame[c] if c in frame else 0 for c in archives.SCHEMAS["klines"]}).assign(open_time=frame["timestamp"] * (1000 if odd else 1))
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr("rows.csv", rows.to_csv(index=False, header=odd))
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/{frame['symbol'].iloc[0]}.{frame['day'].iloc[0]}.zip") as out:
            out.write(held.getvalue())
        return pd.DataFrame({"n": [len(rows)]})

    daily = bars.withColumn("day", F.floor(F.col("timestamp") / 86_400_000).cast("int"))
    daily.groupBy("symbol", "day").applyInPandas(pack, "n long").agg(F.sum("n")).collect()


@register(f"WITH {TICKS}, {bars_sql(HOUR)} SELECT symbol, timestamp, {ROUNDED} FROM b")
def archive_round_trip(spark, sf_dir):
    """Bars to zipped CSV and back: header sniff, names, units of time, numbers."""
    folder = fresh_dir(spark, "archives")
    _zipped(hourly(spark, sf_dir), folder)
    found = archives.convert(archives.read_zipped_csv(spark, folder, "klines"), "klines")
    symbol = F.regexp_extract("file", r"([^/.]+)\.\d+\.zip$", 1)
    return found.select(symbol.alias("symbol"), "timestamp", *[F.round(c, 6).alias(c) for c in BARS])


@register(f"WITH {TICKS}, {bars_sql(HOUR)} SELECT symbol, timestamp, {ROUNDED} FROM b WHERE symbol = 'view' AND timestamp BETWEEN {BUDGET - 86400000 * 5} AND {BUDGET}")
def canonical_range(spark, sf_dir):
    """Bars written by symbol, year and month, and a range of one symbol read back."""
    folder = fresh_dir(spark, "canonical")
    canonical.write(hourly(spark, sf_dir), folder)
    found = canonical.read(spark, folder, start_ms=BUDGET - 86_400_000 * 5, end_ms=BUDGET, symbol="view")
    return found.select("symbol", "timestamp", *[F.round(c, 6).alias(c) for c in BARS])


@register("SELECT CAST(n_nationkey AS BIGINT) AS nation, sha256(n_name || ': ' || n_regionkey || chr(10)) AS sha256, true AS ok, false AS other_ok FROM nation")
def checksums(spark, sf_dir):
    """Digests of a file for each nation, held against those that SQL gives of the text, and against another's."""
    folder = fresh_dir(spark, "texts")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(": "), F.col("n_regionkey").cast("string")).alias("value"))
    rows.repartition("n_nationkey").write.partitionBy("n_nationkey").text(folder)
    found = canonical.file_hashes(spark, f"{folder}/*/part-*")
    nation = F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("long")
    texts = rows.select(F.col("n_nationkey").cast("long").alias("nation"), F.sha2(F.concat("value", F.lit("\n")), 256).alias("want"))
    known = found.select("path", nation.alias("nation")).join(texts, "nation")
    right = canonical.checksum_matches(found, known.select("path", F.concat(F.lit("sha256:"), F.upper("want")).alias("sha256"))).select("path", "ok")
    wrong = canonical.checksum_matches(found, known.select("path", F.sha2("want", 256).alias("sha256"))).select("path", F.col("ok").alias("other_ok"))
    return found.join(right, "path").join(wrong, "path").select(nation.alias("nation"), "sha256", "ok", "other_ok")


@register("SELECT symbol, year, month, day, 'http://x/futures/um/daily/metrics/' || symbol || '/' || symbol || '-metrics-' || strftime(d, '%Y-%m-%d') || '.zip' AS url FROM (SELECT symbol, CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month, CAST(day(d) AS INT) AS day, d FROM (SELECT DISTINCT event_type AS symbol FROM events), (SELECT unnest(generate_series(DATE '2024-01-30', DATE '2024-02-02', INTERVAL 1 DAY)) AS d))")
def daily_urls(spark, sf_dir):
    names = [r.symbol for r in ticks(spark, sf_dir).select("symbol").distinct().collect()]
    return archives.period_urls(spark, "http://x", "futures", "open_interest", names, "2024-01-30", "2024-02-02")


@register(f"WITH {TICKS} SELECT symbol, timestamp, arg_min(price, event_id) AS open_interest FROM (SELECT *, price AS p FROM t) GROUP BY symbol, timestamp")
def daily_consolidation(spark, sf_dir):
    """Daily frames as one: the first row of a symbol and time stays."""
    t = ticks(spark, sf_dir).groupBy("symbol", "timestamp").agg(F.min_by("price", "event_id").alias("open_interest"))
    halves = [t.filter(F.col("timestamp") < BUDGET), t.filter(F.col("timestamp") >= BUDGET - HOUR)]
    return archives.consolidate_daily(halves)


@register(f"WITH {TICKS} SELECT symbol, count(*) AS n, min(timestamp) AS lo FROM t WHERE timestamp BETWEEN {BUDGET - 28800000} AND {BUDGET} GROUP BY symbol")
def lookback_range(spark, sf_dir):
    rows = align.between(ticks(spark, sf_dir), align.lookback(BUDGET), BUDGET)
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), F.min("timestamp").alias("lo"))


@register("SELECT 'trade_count_gte_zero' AS rule, CAST(sum(CASE WHEN l_linenumber - 3 < 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_count FROM lineitem UNION ALL SELECT 'volume_gte_zero', CAST(sum(CASE WHEN l_quantity - 10 < 0 THEN 1 ELSE 0 END) AS BIGINT) FROM lineitem")
def validate_agg_trades(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") - 3).alias("trade_count"), (F.col("l_quantity") - 10).alias("base_volume"))
    return quality.rule_counts(rows, "aggTrades")


@register("SELECT 'bid_lte_ask' AS rule, CAST(sum(CASE WHEN l_extendedprice > l_quantity * 1000 THEN 1 ELSE 0 END) AS BIGINT) AS bad_count FROM lineitem")
def validate_depth(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("best_bid"), (F.col("l_quantity") * 1000).alias("best_ask"))
    return quality.rule_counts(rows, "depth")


@register(f"{STATE}, fv AS (SELECT symbol, min(timestamp) FILTER (open_interest IS NOT NULL) AS first_valid FROM state GROUP BY symbol) SELECT symbol, any_value(first_valid) AS first_valid, CAST(count(*) FILTER (open_interest IS NULL AND timestamp > first_valid) AS BIGINT) AS nulls_after FROM state JOIN fv USING (symbol) GROUP BY symbol")
def nulls_after_first_value(spark, sf_dir):
    return quality.nulls_after_first(_state(spark, sf_dir), "open_interest")


@register(f"WITH {TICKS}, {bars_sql(HOUR)}, {bars_sql(4 * HOUR, 'c')}, f AS (SELECT symbol, count(*) AS fine_rows FROM b GROUP BY 1), g AS (SELECT symbol, count(*) AS coarse_rows FROM c GROUP BY 1) SELECT symbol, fine_rows, coarse_rows, round(fine_rows / coarse_rows, 6) AS ratio, fine_rows / coarse_rows BETWEEN 2 AND 6 AS ok FROM f JOIN g USING (symbol)")
def interval_ratios(spark, sf_dir):
    from .operators import resample

    found = quality.interval_ratio(hourly(spark, sf_dir), resample.bars(ticks(spark, sf_dir), 4 * HOUR), 2.0, 6.0)
    return found.withColumn("ratio", F.round("ratio", 6))


@register(f"WITH {TICKS}, {bars_sql(HOUR)} SELECT (SELECT count(*) = count(DISTINCT (symbol, timestamp)) FROM b) AS bars_increase, (SELECT count(*) = count(DISTINCT timestamp) FROM t) AS ticks_increase")
def monotonic_guard(spark, sf_dir):
    """Whether the guard lets bars pass, and all ticks as one series."""

    def passes(rows: DataFrame, keys: tuple[str, ...]) -> bool:
        try:
            windows.check_increasing(rows, keys)
        except ValueError:
            return False
        return True

    held = (passes(hourly(spark, sf_dir), ("symbol",)), passes(ticks(spark, sf_dir).withColumn("all", F.lit(1)), ("all",)))
    return spark.createDataFrame([held], "bars_increase boolean, ticks_increase boolean")


@register("SELECT o_orderstatus AS symbol, CASE WHEN o_custkey % 3 = 0 THEN '1h' ELSE '4h' END || '_' || CAST(year(o_orderdate) AS VARCHAR) || '_' || CAST(month(o_orderdate) AS VARCHAR) AS name, o_custkey AS rows, CASE WHEN o_custkey % 2 = 0 THEN 'RESAMPLED' ELSE 'UNKNOWN' END AS status FROM orders WHERE o_orderkey % 3 <> 0")
def resample_statistics(spark, sf_dir):
    f = _files(spark, sf_dir).withColumn("dataset_type", F.when(F.col("o_orderkey") % 3 != 0, "klines").otherwise("funding"))
    f = f.withColumn("interval", F.when(F.col("row_count") % 3 == 0, "1h").otherwise("4h")).withColumn("status", F.when(F.col("row_count") % 2 == 0, "RESAMPLED"))
    return quality.resample_statistics(f)


@register("SELECT o_orderstatus AS symbol, '4h' AS interval, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month FROM orders WHERE o_custkey % 2 = 0")
def incomplete_history(spark, sf_dir):
    f = _files(spark, sf_dir).withColumn("dataset_type", F.lit("klines")).withColumn("interval", F.lit("4h"))
    return quality.incomplete_history(f.withColumn("status", F.when(F.col("row_count") % 2 == 0, "RESAMPLED_INCOMPLETE").otherwise("RESAMPLED")))


@register("SELECT count(*) AS file_count, CAST(sum(o_custkey) AS BIGINT) AS total_rows, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total_bytes, round_even(sum(CAST(floor(o_totalprice) AS BIGINT)) / 1048576.0, 2) AS total_mb FROM orders")
def storage_totals(spark, sf_dir):
    return catalog.storage_summary(_files(spark, sf_dir))


@register("SELECT label, round(sum(list_sum(list_transform(list_filter(embedding, lambda x: x > 0), lambda x: CAST(x AS DOUBLE) * x))) / sum(len(list_filter(embedding, lambda x: x > 0))), 5) AS mean_loss FROM embeddings GROUP BY label")
def masked_loss_means(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    rows = e.select("label", F.transform(V.doubles(F.col("embedding")), lambda x: x * x).alias("loss"), F.transform("embedding", lambda x: x > 0).alias("mask"))
    return metrics.masked_loss(rows, keys=["label"]).withColumn("mean_loss", F.round("mean_loss", 5))


def _windows(spark, sf_dir) -> DataFrame:
    packed = features.raw_features(hourly(spark, sf_dir).select("symbol", "timestamp", *BARS), order=BARS)
    return windows.create_windows(packed, SPEC)


@register(f"{WINDOWS} SELECT max((end_ts - start_ts) // 60000) + 1 AS max_position FROM win")
def max_position(spark, sf_dir):
    return windows.max_position(_windows(spark, sf_dir))


@register(f"{WINDOWS} SELECT w.symbol, w.start_ts, 40 AS numbers, round(sum(CAST(r.open AS FLOAT) + CAST(r.close AS FLOAT)), 3) AS total FROM win w JOIN g r ON r.symbol = w.symbol AND r.i BETWEEN w.i AND w.i + 7 GROUP BY w.symbol, w.start_ts")
def flat_windows(spark, sf_dir):
    """Windows as one row of numbers: 8 rows of 5 features; opens and closes stand at places 0 and 3 of each."""
    own = _windows(spark, sf_dir).select("symbol", F.col("metadata.start_ts").alias("start_ts"), V.flat(F.col("features")).alias("flat"))
    picked = F.filter("flat", lambda x, i: (i % 5 == 0) | (i % 5 == 3))
    total = F.aggregate(picked, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return own.select("symbol", "start_ts", F.size("flat").alias("numbers"), F.round(total, 3).alias("total"))


@register(f"WITH {SCORED} SELECT round(avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM s")
def accuracy(spark, sf_dir):
    return metrics.accuracy(_scored(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


@register(f"""WITH {NORMS}, c AS (SELECT label AS a, regime AS b, count(*) AS n FROM g GROUP BY ALL), ra AS (SELECT a, sum(n) AS s FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS s FROM c GROUP BY b), z AS (SELECT sum(n) AS t FROM c),
h AS (SELECT (SELECT -sum(s / t * ln(s / t)) FROM ra, z) AS ha, (SELECT -sum(s / t * ln(s / t)) FROM rb, z) AS hb, (SELECT sum(n / t * ln(t * n / (ra.s * rb.s))) FROM c JOIN ra USING (a) JOIN rb USING (b), z) AS mi),
p AS (SELECT CAST(ra.s AS BIGINT) AS a, CAST(rb.s AS BIGINT) AS b, CAST(t AS BIGINT) AS t, unnest(generate_series(greatest(1, CAST(ra.s + rb.s - t AS BIGINT)), CAST(least(ra.s, rb.s) AS BIGINT))) AS n FROM ra, rb, z),
e AS (SELECT sum(n / t * ln(t * n / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(n + 1) - lgamma(a - n + 1) - lgamma(b - n + 1) - lgamma(t - a - b + n + 1))) AS em FROM p)
SELECT round((mi - em) / ((ha + hb) / 2 - em), 6) AS ami FROM h, e""")
def adjusted_mutual_info(spark, sf_dir):
    rows = metrics.norm_regime(table(spark, sf_dir, "embeddings"))
    return spark.createDataFrame([(round(metrics.adjusted_mutual_info(metrics.contingency(rows, "label", "regime")), 6),)], "ami double")


@register("SELECT l_orderkey, l_linenumber, round((l_extendedprice - (SELECT quantile_disc(l_extendedprice, 0.5) FROM lineitem)) / (SELECT quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) FROM lineitem), 6) AS l_extendedprice FROM lineitem")
def robust_apply(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return stats.Normalizer("robust").fit(rows, ["l_extendedprice"]).transform(rows).withColumn("l_extendedprice", F.round("l_extendedprice", 6))


@register(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(sum(CAST({c} AS DOUBLE)), 2) AS total FROM lineitem" for c in (*LINE, "l_tax", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")))
def numeric_columns(spark, sf_dir):
    """Counts and sums of whatever columns of lineitem are numeric."""
    rows = table(spark, sf_dir, "lineitem")
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in stats.numeric_columns(rows)])
    return rows.select(F.explode(each).alias("e")).groupBy("e.column").agg(F.count("e.x").alias("n"), F.round(F.sum("e.x"), 2).alias("total"))


@register(f"{WINDOWS} SELECT CAST(count(*) // 8 AS BIGINT) AS batches, CASE WHEN count(*) >= 8 THEN 8 END AS smallest, CASE WHEN count(*) >= 8 THEN 8 END AS largest, CAST(count(*) // 8 * 8 AS BIGINT) AS windows FROM win")
def epoch_batches(spark, sf_dir):
    """A shuffled epoch without its last, partial batch: sizes of batches, and that no window comes twice."""
    w = windows.window_starts(hourly(spark, sf_dir), SPEC)
    rows = sampling.batches(w, 8, [sampling.chance(7, "symbol", "start_ts"), "symbol", "start_ts"], drop_last=True)
    sizes = rows.groupBy("batch").agg(F.countDistinct("symbol", "start_ts").alias("n"))
    return sizes.agg(F.count("*").alias("batches"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.coalesce(F.sum("n"), F.lit(0)).alias("windows"))


@register("SELECT count(*) AS vectors, true AS uncorrelated, true AS ordered, true AS within FROM embeddings")
def pca_properties(spark, sf_dir):
    """Principal places have no correlation, fall in variance, and have no more of it than the vectors."""
    e = table(spark, sf_dir, "embeddings")
    found = metrics.pca(e).select(V.doubles(F.col("pca"))[0].alias("x"), V.doubles(F.col("pca"))[1].alias("y"))
    total = sum(s * s for s in metrics.scaling(e)[1])
    x, y = F.var_pop("x"), F.var_pop("y")
    return found.agg(F.count("*").alias("vectors"), (F.abs(F.covar_pop("x", "y")) < 1e-6 * x).alias("uncorrelated"), (x >= y).alias("ordered"), (x + y <= F.lit(total * (1 + 1e-9))).alias("within"))


def _doubled(frame: DataFrame) -> DataFrame:
    """A fixed model: twice the first two places of a vector."""
    from .plans.pipeline import embed

    return embed(frame.select("vec_id", F.col("embedding").alias("features")), lambda vs: [[2.0 * v[0], 2.0 * v[1]] for v in vs], 2)


@register("SELECT label, count(*) AS n, round(sum(2.0 * CAST(embedding[1] AS DOUBLE)), 4) AS first, round(sum(2.0 * CAST(embedding[2] AS DOUBLE)), 4) AS second, (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 0) AS computed_first, (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 1) AS computed_then, CAST(0 AS BIGINT) AS computed_last, (SELECT count(*) FROM embeddings WHERE vec_id % 10 = 0) AS computed_changed FROM embeddings GROUP BY label")
def cached_embeddings(spark, sf_dir):
    """A part of the vectors, then all, then all again, then with a tenth of them changed: only what is not held is computed."""
    from .plans.cache import EmbeddingCache

    e = table(spark, sf_dir, "embeddings")
    cache = EmbeddingCache(spark, fresh_dir(spark, "cache"), {"model": "doubled", "version": 1})
    changed = e.withColumn("embedding", F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x: x + F.lit(1).cast("float"))).otherwise(F.col("embedding")))
    (_, first), (_, then), (found, last), (_, more) = (cache.through(x.select("vec_id", F.col("embedding").alias("vector"), "label"), ["vec_id"], ["vector"], lambda x: _doubled(x.withColumnRenamed("vector", "embedding")).select("vec_id", "embedding")) for x in (e.filter("vec_id % 2 = 0"), e, e, changed))
    counts = {"computed_first": first, "computed_then": then, "computed_last": last, "computed_changed": more}
    return found.groupBy("label").agg(F.count("*").alias("n"), *[F.round(F.sum(F.col("embedding")[i]), 4).alias(name) for i, name in enumerate(("first", "second"))]).withColumns({k: F.lit(v).cast("long") for k, v in counts.items()})


def _linear(features, mask):
    """A fixed linear encoder: (x, 1 - x / 50) of each step, and of the whole window (first x, number of steps that count)."""
    import numpy as np

    x = features[:, :, 0]
    steps = np.stack([x, 1 - x / 50], axis=2)
    whole = np.stack([x[:, 0], mask.sum(axis=1)], axis=1)[:, None, :]
    return np.concatenate([whole, steps], axis=1)


@register(f"""{WINDOWS}, x AS (SELECT w.symbol, w.start_ts, w.end_ts, r.gap, r.i - w.i AS pos, coalesce(CASE WHEN r.volume > 20 THEN r.volume END, 0) AS x, coalesce(r.volume > 20, false) AS seen FROM win w JOIN g r ON r.symbol = w.symbol AND r.i BETWEEN w.i AND w.i + 7), m AS (SELECT symbol, start_ts, median(gap) AS med FROM x WHERE pos < 7 GROUP BY ALL),
k AS (SELECT x.*, seen AND (pos = 7 OR gap <= 2 * floor(med)) AS kept, (x + 1 - x / 50) / sqrt(2) AS score FROM x JOIN m USING (symbol, start_ts)), s AS (SELECT *, max(CASE WHEN kept THEN score END) OVER (PARTITION BY symbol, start_ts) AS top FROM k),
pe AS (SELECT symbol, start_ts, CASE WHEN any_value(end_ts) < {BUDGET} THEN 'train' WHEN start_ts >= {BUDGET} THEN 'test' ELSE 'between' END AS split, arg_min(x, pos) AS c0, CAST(count(CASE WHEN kept THEN 1 END) AS DOUBLE) AS c1, coalesce(avg(CASE WHEN kept THEN x END), 0) AS m0, coalesce(avg(CASE WHEN kept THEN 1 - x / 50 END), 0) AS m1,
 coalesce(sum(CASE WHEN kept THEN exp(score - top) * x END) / sum(CASE WHEN kept THEN exp(score - top) END), 0) AS a0, coalesce(sum(CASE WHEN kept THEN exp(score - top) * (1 - x / 50) END) / sum(CASE WHEN kept THEN exp(score - top) END), 0) AS a1 FROM s GROUP BY symbol, start_ts)
SELECT symbol, start_ts, split, pooling, round(e0, 4) AS e0, round(e1, 4) AS e1 FROM (SELECT symbol, start_ts, split, unnest(['cls', 'mean', 'attention']) AS pooling, unnest([c0, m0, a0]) AS e0, unnest([c1, m1, a1]) AS e1 FROM pe)""")
def pooled_embeddings(spark, sf_dir):
    """All poolings of all windows from one run of a fixed linear encoder, by split."""
    from .plans.embeddings import pooled_embeddings as pooled

    start, end = F.col("metadata.start_ts"), F.col("metadata.end_ts")
    w = volume_windows(spark, sf_dir).select("symbol", start.alias("start_ts"), F.when(end < BUDGET, "train").when(start >= BUDGET, "test").otherwise("between").alias("split"), "features", "mask")
    found = pooled(w, _linear, keep=("symbol", "start_ts", "split"))
    return found.select("symbol", "start_ts", "split", "pooling", *[F.round(F.col("embedding")[i], 4).alias(f"e{i}") for i in range(2)])


@register("""WITH e AS (SELECT vec_id, label, CASE WHEN vec_id % 4 = 0 THEN 'validation' ELSE 'train' END AS split, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT vec_id, label, split, 'cls' AS pooling, v[1:16] AS v FROM e UNION ALL SELECT vec_id, label, split, 'mean', v FROM e),
c AS (SELECT a.split, a.pooling, a.vec_id, a.label = b.label AS same, row_number() OVER (PARTITION BY a.split, a.pooling, a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.vec_id) AS rank FROM p a JOIN p b ON a.split = b.split AND a.pooling = b.pooling AND a.vec_id <> b.vec_id)
SELECT split, pooling, CAST(10 AS BIGINT) AS k, count(DISTINCT vec_id) AS n_samples, round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 3) AS same_rate, round(1 - avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 3) AS cross_rate, true AS valid FROM c WHERE rank <= 10 GROUP BY split, pooling""")
def retrieval_reports(spark, sf_dir):
    """A document for each split and pooling, written as files and read back. Splits and two poolings of the vectors, all against all of their own."""
    from .plans import reports

    e = table(spark, sf_dir, "embeddings").withColumn("split", F.when(F.col("vec_id") % 4 == 0, "validation").otherwise("train"))
    both = e.withColumn("pooling", F.lit("mean")).unionByName(e.withColumn("pooling", F.lit("cls")).withColumn("embedding", F.slice("embedding", 1, 16)))
    folder = fresh_dir(spark, "reports")
    reports.write_reports(reports.retrieval_report(both, label="label"), folder, "retrieval")
    found = reports.read_reports(spark, folder, "retrieval", "split string, pooling string, k long, n_samples long, same_rate double, cross_rate double, valid boolean")
    return found.withColumns({c: F.bround(c, 3) for c in ("same_rate", "cross_rate")})


@register("SELECT CAST(12 AS BIGINT) AS batches, CAST(12 * 64 AS BIGINT) AS samples, CAST(12 * 64 * 3 * 4 AS BIGINT) AS bytes, (count(*) + 63) // 64 AS all_batches, count(*) AS all_samples FROM lineitem")
def loader_benchmark(spark, sf_dir):
    """A dozen batches of all rows from tasks that stop early, and a pass over all of them in as many tasks as read them; times are left out."""
    from .plans.throughput import benchmark

    rows = table(spark, sf_dir, "lineitem").select(*LINE)
    some, every = benchmark(rows.repartition(4), len(LINE), 64, 12), benchmark(rows, len(LINE), 64, None)
    return spark.createDataFrame([(*(int(some[c]) for c in ("batches", "samples", "bytes")), int(every["batches"]), int(every["samples"]))], "batches long, samples long, bytes long, all_batches long, all_samples long")


@register("SELECT c_custkey AS symbol, c_mktsegment AS market_type, max(o_orderdate) AS valid_from FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey % 3 = 0 GROUP BY ALL")
def requested_assets(spark, sf_dir):
    """Current versions of the assets that are asked for, from a catalogue table that is written in two goes and read back."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    rows = c.join(o, c["c_custkey"] == o["o_custkey"]).select(F.col("c_custkey").cast("string").alias("symbol"), F.col("c_mktsegment").alias("market_type"), F.col("o_orderdate").cast("timestamp").alias("valid_from"), F.lit(True).alias("is_active")).distinct()
    rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in catalog.ASSETS])
    held = catalog.Table(spark, fresh_dir(spark, "assets"), catalog.ASSETS)
    catalog.register_assets(held, rows.filter("valid_from < '1995-06-01'"))
    catalog.register_assets(held, rows.filter("valid_from >= '1995-06-01'"))
    asked = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("symbol"))
    found = catalog.requested_assets(held.read(), asked)
    return found.select(F.col("symbol").cast("long").alias("symbol"), "market_type", F.col("valid_from").cast("timestamp_ntz").alias("valid_from"))


@register("SELECT o_orderkey, round(CASE WHEN step < 20 THEN step / 20.0 ELSE 0.5 * (1 + cos(pi() * least(greatest((step - 20) / 80.0, 0), 1))) END, 9) AS rate FROM (SELECT o_orderkey, o_orderkey % 120 AS step FROM orders)")
def learning_rates(spark, sf_dir):
    from .functions.numbers import learning_rate

    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(learning_rate(F.col("o_orderkey") % 120, 20, 100), 9).alias("rate"))


@register(f"WITH {TICKS} SELECT symbol, timestamp, price FROM t")
def time_aliases(spark, sf_dir):
    """Ticks whose time has another name, in microseconds for some symbols and milliseconds for others, and as ISO text for the rest."""
    t = ticks(spark, sf_dir).select("symbol", "timestamp", "price")
    parts = [t.filter("symbol < 'e'").select("symbol", (F.col("timestamp") * 1_000).cast("string").alias("transact_time"), "price"), t.filter("symbol >= 'e' AND symbol < 's'").select("symbol", F.col("timestamp").cast("string").alias("transact_time"), "price"), t.filter("symbol >= 's'").select("symbol", F.date_format(F.timestamp_millis("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("transact_time"), "price")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return archives.convert(rows, "aggTrades", ("symbol",)).select("symbol", "timestamp", "price")


@register(f"WITH {TICKS}, f AS (SELECT 'f' || CAST(event_id AS VARCHAR) AS file_id, symbol FROM t), s AS (SELECT file_id, sha256(file_id || '!') AS sha FROM f WHERE symbol IN ('click', 'view')) SELECT count(*) AS files, sha256('{{' || string_agg('\"' || file_id || '\": \"' || sha || '\"', ', ' ORDER BY file_id) || '}}|{{\"alignment_version\": \"alignment_v1.yaml\", \"canonical_schema_version\": \"v1\", \"feature_builder_version\": \"v1\", \"market_state_schema_version\": \"v1\", \"modality_registry\": \"modalities_v1.yaml\", \"snapshot\": \"s1\", \"windowing_version\": \"windowing_v1.yaml\"}}') AS fingerprint FROM s")
def dataset_fingerprint(spark, sf_dir):
    """Of a manifest whose ledger has a file for each tick of two symbols; the ledger stays a table."""
    from .plans import manifests

    files = ticks(spark, sf_dir).select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("file_id"), "symbol")
    manifest = manifests.build_manifest("s1", ["click"], ["view"], [], "2024-01-15")
    found = manifests.fingerprint_of_table(manifest, files.withColumn("sha256", F.sha2(F.concat("file_id", F.lit("!")), 256)))
    return spark.createDataFrame([(found["file_count"], found["fingerprint"])], "files long, fingerprint string")


@register("SELECT * FROM (SELECT 'run' || CAST(o_orderkey AS VARCHAR) AS experiment_id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place, round(o_totalprice, 2) AS loss FROM orders)")
def experiment_log(spark, sf_dir):
    """A run for each order, logged as one set, one more that is refused, newest first."""
    o = table(spark, sf_dir, "orders")
    held = catalog.Table(spark, fresh_dir(spark, "experiments"), catalog.EXPERIMENTS)
    at = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey"))
    rows = o.select(F.concat(F.lit("run"), F.col("o_orderkey").cast("string")).alias("experiment_id"), F.to_json(F.struct(F.round("o_totalprice", 2).alias("loss"))).alias("metrics"), at.alias("created_at"))
    catalog.log_experiments(held, rows)
    first = rows.first()["experiment_id"]
    try:
        catalog.log_experiment(held, {"experiment_id": first})
    except ValueError:
        pass
    else:
        raise RuntimeError("an experiment was logged twice")
    found = numbered(catalog.experiments(held).withColumn("age", -F.unix_micros("created_at")), "age", name="place")
    return found.select("experiment_id", (F.col("place") + 1).alias("place"), F.get_json_object("metrics", "$.loss").cast("double").alias("loss"))
