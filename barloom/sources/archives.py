"""Zipped CSV archives as frames: header sniffing, canonical names, time units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructField, StructType

from ..operators.stats import thresholds

#: Column orders of headerless files, and the canonical names of raw columns.
SCHEMAS = {
    "klines": ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "count", "taker_buy_volume", "taker_buy_quote_volume", "ignore"),
    "aggTrades": ("agg_trade_id", "price", "quantity", "first_trade_id", "last_trade_id", "transact_time", "is_buyer_maker"),
    "trades": ("trade_id", "price", "qty", "quote_qty", "time", "is_buyer_maker"),
    "funding": ("calc_time", "funding_interval_hours", "last_funding_rate"),
    "open_interest": ("create_time", "symbol", "sum_open_interest", "sum_open_interest_value"),
}
RENAMES = {
    "klines": {"open_time": "timestamp"},
    "aggTrades": {"transact_time": "timestamp"},
    "trades": {"time": "timestamp"},
    "funding": {"calc_time": "timestamp", "last_funding_rate": "funding_rate"},
    "open_interest": {"create_time": "timestamp", "symbol": "base_symbol", "sum_open_interest": "open_interest", "sum_open_interest_value": "open_interest_value"},
}
TIME_NAMES = ("open_time", "openTime", "transact_time", "time", "calc_time", "fundingTime", "settlement_time")
#: Folder of each dataset type at the archive site.
REMOTE = {"klines": "klines", "funding": "fundingRate", "open_interest": "metrics", "aggTrades": "aggTrades", "trades": "trades", "depth": "depth", "liquidations": "liquidations"}
#: Fixed value: the types that have an archive for each month; others have one for each day.
MONTHLY = ("klines", "funding", "aggTrades", "trades")


def has_header(line: str) -> bool:
    """A first line is a header unless it begins with a digit or a sign."""
    return bool(line) and not (line[0].isdigit() or line[0] in "+-")


def read_zipped_csv(spark: SparkSession, path: str, dataset_type: str, columns: list[str] | None = None) -> DataFrame:
    """file and the columns, as strings, of the first member of each archive at `path`.

    Names are those of the dataset type or `columns`; of an unknown type the first line of the first file names them, header or
    not. A file's header maps its own columns. Each archive is read by one task and given in batches.
    """
    names = list(columns or SCHEMAS.get(dataset_type, ()))
    files = spark.read.format("binaryFile").load(path)
    if not names:
        first = files.orderBy("path").limit(1).select("content").first()
        if first is None:
            raise FileNotFoundError(path)
        names = _lines(bytes(first["content"]), 1)[0].split(",")
    schema = StructType([StructField(n, StringType()) for n in ["file", *names]])
    fixed = dataset_type in SCHEMAS or columns is not None

    def parse(batches):
        import csv
        import io
        import zipfile

        import pandas as pd

        for frame in batches:
            for at, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as raw:
                    lines = csv.reader(io.TextIOWrapper(raw, "utf-8"))
                    own, rows, first = names, [], True
                    for line in lines:
                        if first and (has_header(",".join(line)) or not fixed):
                            own = [x.strip() for x in line]
                        elif line:
                            rows.append([at, *(dict(zip(own, line, strict=False)).get(n) for n in names)])
                        first = False
                        if len(rows) >= 50_000:
                            yield pd.DataFrame(rows, columns=["file", *names])
                            rows = []
                    yield pd.DataFrame(rows, columns=["file", *names])

    return files.select("path", "content").mapInPandas(parse, schema)


def _lines(content: bytes, n: int) -> list[str]:
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as raw:
        return [raw.readline().decode().strip() for _ in range(n)]


def canonical_names(frame: DataFrame, dataset_type: str) -> DataFrame:
    """Raw names made canonical where present; if there is no timestamp then, the first known time column is it."""
    frame = frame.withColumnsRenamed({k: v for k, v in RENAMES.get(dataset_type, {}).items() if k in frame.columns and v not in frame.columns})
    if "timestamp" not in frame.columns:
        found = next((c for c in TIME_NAMES if c in frame.columns), None)
        if found:
            frame = frame.withColumnRenamed(found, "timestamp")
    return frame


def in_milliseconds(ts: Column, median: Column) -> Column:
    """A numeric time in ms, given the median of its file: microseconds from 1e15, nanoseconds from 1e17, both up to the next."""
    whole = ts.cast("long")
    return F.when((median > 1e15) & (median < 1e17), (whole / 1000).cast("long")).when((median > 1e17) & (median < 1e19), (whole / 1_000_000).cast("long")).otherwise(whole)


def normalise_times(frame: DataFrame, keys: tuple[str, ...] = ("file",), column: str = "timestamp") -> DataFrame:
    """`column` as whole milliseconds. The unit is chosen by the median of each file; texts that are no numbers are read as ISO
    times in UTC. What is neither becomes null."""
    if isinstance(frame.schema[column].dataType, NumericType):
        number = F.col(column).cast("double")
    else:
        number = F.expr(f"try_cast(`{column}` AS DOUBLE)")
    frame = frame.withColumn("_number", number)
    medians = thresholds(frame, ["_number"], list(keys)).withColumnRenamed("_number_threshold", "_median")
    iso = F.unix_millis(F.try_to_timestamp(F.col(column).cast("string")))
    exact = F.col(column).cast("long") if isinstance(frame.schema[column].dataType, NumericType) else F.coalesce(F.expr(f"try_cast(`{column}` AS BIGINT)"), F.col("_number").cast("long"))
    value = F.when(F.col("_number").isNotNull(), in_milliseconds(exact, F.col("_median"))).otherwise(iso)
    return frame.join(medians, list(keys), "left").withColumn(column, value).drop("_number", "_median")


def convert(frame: DataFrame, dataset_type: str, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Canonical names, times in ms, rows without a time dropped, other columns numeric where they are numbers."""
    frame = normalise_times(canonical_names(frame, dataset_type), keys).filter("timestamp IS NOT NULL")
    numeric = [c for c in frame.columns if c not in (*keys, "timestamp", "is_buyer_maker", "symbol", "side")]
    return frame.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in numeric})


def summary(frame: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """For each file: row_count, start_ts, end_ts."""
    return frame.groupBy(*keys).agg(F.count("*").alias("row_count"), F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"))


def consolidate_daily(frames: list[DataFrame], keep: tuple[str, ...] = ("timestamp", "symbol", "open_interest", "open_interest_value")) -> DataFrame:
    """Daily frames as one: of rows with one symbol and time the first frame's stays, sorted by time within partitions."""
    from ..operators.quality import keep_first

    united = None
    for i, frame in enumerate(frames):
        rows = frame.withColumn("_day", F.lit(i))
        united = rows if united is None else united.unionByName(rows, allowMissingColumns=True)
    if united is None:
        raise ValueError("no frames")
    keys = [c for c in ("symbol", "timestamp") if c in united.columns]
    rows = keep_first(united.filter("timestamp IS NOT NULL"), keys, ["_day"])
    return rows.select(*[c for c in keep if c in rows.columns]).sortWithinPartitions(*keys)


def archive_url(base: str, market: str, dataset_type: str, symbol: Column, year: Column, month: Column, interval: str = "1m", day: Column | None = None) -> Column:
    """URLs of monthly archives, or with `day` of daily ones. Futures lie under futures/um; bars have an interval folder."""
    remote = REMOTE[dataset_type]
    folder = "futures/um" if market == "futures" else market
    parts = [F.lit(f"{base}/{folder}/{'monthly' if day is None else 'daily'}/{remote}/"), symbol]
    middle = f"/{interval}/" if dataset_type == "klines" else "/"
    name = interval if dataset_type == "klines" else remote
    date = [year.cast("string"), F.lpad(month.cast("string"), 2, "0"), *([] if day is None else [F.lpad(day.cast("string"), 2, "0")])]
    return F.concat(*parts, F.lit(middle), symbol, F.lit(f"-{name}-"), F.concat_ws("-", *date), F.lit(".zip"))


def period_urls(spark: SparkSession, base: str, market: str, dataset_type: str, symbols: list[str], start: str, end: str, interval: str = "1m") -> DataFrame:
    """symbol, year, month, day (null for monthly archives), url of every archive of a closed range of dates."""
    monthly = dataset_type in MONTHLY
    step = F.expr("INTERVAL 1 MONTH" if monthly else "INTERVAL 1 DAY")
    first = F.trunc(F.lit(start).cast("date"), "month") if monthly else F.lit(start).cast("date")
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, symbols))).alias("symbol")).withColumn("d", F.explode(F.sequence(first, F.lit(end).cast("date"), step)))
    day = None if monthly else F.dayofmonth("d")
    url = archive_url(base, market, dataset_type, F.col("symbol"), F.year("d"), F.month("d"), interval, day)
    return rows.select("symbol", F.year("d").alias("year"), F.month("d").alias("month"), (F.lit(None).cast("int") if monthly else day).alias("day"), url.alias("url"))


def asset_rows(payload: DataFrame, column: str = "json") -> DataFrame:
    """symbol, base_asset, quote_asset, tick_size, step_size, min_qty, is_active of an exchange-information document."""
    shape = "symbols ARRAY<STRUCT<symbol: STRING, baseAsset: STRING, quoteAsset: STRING, status: STRING, filters: ARRAY<MAP<STRING, STRING>>>>"
    rows = payload.select(F.explode(F.from_json(column, shape)["symbols"]).alias("s")).select("s.*")
    by_type = F.map_from_entries(F.transform("filters", lambda f: F.struct(f["filterType"], f)))
    held = rows.withColumn("f", by_type)

    def pick(kind: str, name: str) -> Column:
        return F.expr(f"try_cast(f['{kind}']['{name}'] AS DOUBLE)")

    return held.select("symbol", F.col("baseAsset").alias("base_asset"), F.col("quoteAsset").alias("quote_asset"), pick("PRICE_FILTER", "tickSize").alias("tick_size"), pick("LOT_SIZE", "stepSize").alias("step_size"), pick("LOT_SIZE", "minQty").alias("min_qty"), (F.col("status") == "TRADING").alias("is_active"))


def history_rows(payload: DataFrame, kind: str, column: str = "json") -> DataFrame:
    """symbol, timestamp and the value of a document of past funding rates (kind funding) or open interest (open_interest)."""
    at, value, name = {"funding": ("fundingTime", "fundingRate", "funding_rate"), "open_interest": ("timestamp", "sumOpenInterest", "open_interest")}[kind]
    rows = payload.select(F.explode(F.from_json(column, "array<map<string,string>>")).alias("r"))
    return rows.select(F.col("r")["symbol"].alias("symbol"), F.expr(f"try_cast(r['{at}'] AS BIGINT)").alias("timestamp"), F.expr(f"try_cast(r['{value}'] AS DOUBLE)").alias(name))


def fetch(urls: DataFrame, folder: str, get, retries: int = 3, wait_s: float = 1.0) -> DataFrame:
    """(url, path, status) of downloads by `get(url) -> bytes | None` on the executors, into a shared folder (an absolute path or a URI).

    A file that is there and not empty is skipped; None is absent; errors are tried again after a growing wait, then failed. Files
    appear under their names only when whole. `urls` should have as many partitions as downloads may run at once.
    """

    def run(batches):
        import time
        import uuid

        import pandas as pd
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def attempt(url: str, name: str) -> str:
            held = store.get_file_info(f"{root}/{name}")
            if held.is_file and held.size:
                return "skipped"
            for wait in range(1, retries + 1):
                try:
                    content = get(url)
                    if content is None:
                        return "absent"
                    draft = f"{root}/{name}.{uuid.uuid4().hex}"
                    with store.open_output_stream(draft) as out:
                        out.write(content)
                    store.move(draft, f"{root}/{name}")
                    return "downloaded"
                except OSError:
                    time.sleep(wait_s * wait)
            return "failed"

        for frame in batches:
            names = [url.rsplit("/", 1)[-1] for url in frame["url"]]
            status = [attempt(url, name) for url, name in zip(frame["url"], names, strict=True)]
            paths = [f"{folder}/{name}" if s in ("downloaded", "skipped") else None for name, s in zip(names, status, strict=True)]
            yield pd.DataFrame({"url": frame["url"], "path": paths, "status": status})

    return urls.select("url").mapInPandas(run, "url string, path string, status string")


__all__ = ["SCHEMAS", "RENAMES", "has_header", "read_zipped_csv", "canonical_names", "normalise_times", "convert", "summary", "consolidate_daily", "archive_url", "asset_rows", "history_rows", "fetch"]
