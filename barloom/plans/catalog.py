"""Catalogues of files, assets and experiments as tables that are read, merged and written as new versions.

A version is a folder; the pointer file names the current one and is put in place last, whole, so readers see whole versions. One
writer at a time is assumed. Old versions stay for readers that have begun, until `vacuum` removes them.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from .files import put_text

_TYPES = {"string": StringType(), "int": IntegerType(), "bigint": LongType(), "double": DoubleType(), "boolean": BooleanType(), "timestamp": TimestampType()}


def _schema(columns: str) -> StructType:
    """A schema of "name type, ..."; unlike a DDL string it needs no session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


FILES = _schema("file_id string, market string, symbol string, dataset_type string, interval string, year int, month int, path string, start_ts bigint, end_ts bigint, row_count bigint, size_bytes bigint, sha256 string, status string, version string, created_at timestamp")
ASSETS = _schema("symbol string, market_type string, base_asset string, quote_asset string, tick_size double, step_size double, min_qty double, is_active boolean, valid_from timestamp, valid_to timestamp")
EXPERIMENTS = _schema("experiment_id string, name string, model string, dataset_fingerprint string, config string, seed int, status string, metrics string, checkpoint string, git_commit string, notes string, started_at timestamp, finished_at timestamp, created_at timestamp")


class Table:
    """A versioned table in a folder that Spark's file systems reach; made empty on first use."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _pointer(self):
        jvm, path = self.spark._jvm, f"{self.path}/current"
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def version(self) -> str | None:
        fs, at = self._pointer()
        return self.spark.read.text(f"{self.path}/current").first()[0] if fs.exists(at) else None

    def read(self) -> DataFrame:
        held = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{held}") if held else self.spark.createDataFrame([], self.schema)

    def write(self, frame: DataFrame) -> None:
        version = f"v{time.time_ns()}"
        frame.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).write.parquet(f"{self.path}/{version}")
        put_text(self.spark, f"{self.path}/current", version)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes all but the last `keep` versions, never the current one; the names of what went."""
        fs, _ = self._pointer()
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v*")
        found = sorted((f.getPath() for f in fs.globStatus(at) or []), key=lambda p: int(p.getName()[1:]))
        gone = [p for p in found[: max(0, len(found) - keep)] if p.getName() != self.version()]
        for path in gone:
            fs.delete(path, True)
        return [p.getName() for p in gone]


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of rows with equal keys the last by `order`."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def merge_files(current: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by file_id: of equal ids the newest created_at wins, and of equal times the new rows' one."""
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, ["file_id"], [F.desc("_new"), F.desc("created_at")]).drop("_new")


def register_files(table: Table, rows: list[tuple] | DataFrame) -> None:
    """One new version with all rows, or none: rows of another width than the table's columns are a ValueError. created_at may be
    left out of tuples."""
    if not isinstance(rows, DataFrame):
        width = len(FILES) - 1
        if bad := [r for r in rows if len(r) != width]:
            raise ValueError(f"{len(bad)} rows do not have {width} values")
        rows = table.spark.createDataFrame(rows, StructType(FILES.fields[:-1]))
    if "created_at" not in rows.columns:
        rows = rows.withColumn("created_at", F.current_timestamp())
    table.write(merge_files(table.read(), rows))


def query_files(files: DataFrame, **equal) -> DataFrame:
    """Rows that meet all given equalities, sorted by symbol, year and month (nulls last); empty values, 0 included, are not asked."""
    for name, value in equal.items():
        if value:
            files = files.filter(F.col(name) == value)
    return files.orderBy(F.asc_nulls_last("symbol"), F.asc_nulls_last("year"), F.asc_nulls_last("month"))


def delete_file(table: Table, file_id: str) -> None:
    table.write(table.read().filter(~F.col("file_id").eqNullSafe(file_id)))


def orphans(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows whose path is not in `listing` (path); rows without a path are none."""
    return files.filter((F.col("path").isNotNull()) & (F.col("path") != "")).join(listing.select("path").distinct(), "path", "left_anti")


def cleanup_orphaned(table: Table, listing: DataFrame) -> int:
    """Removes rows whose file is gone; how many."""
    files = table.read()
    gone = orphans(files, listing).select("file_id").distinct()
    n = gone.count()
    if n:
        table.write(files.join(gone, "file_id", "left_anti"))
    return n


def merge_assets(current: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("symbol", "market_type")) -> DataFrame:
    """Type-2 history: each version of a key is valid from its valid_from to the next one's; the last has no end."""
    both = current.drop("valid_to").unionByName(new.drop("valid_to"), allowMissingColumns=True).distinct()
    return both.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("valid_from")))


def register_assets(table: Table, rows: DataFrame) -> None:
    if "valid_from" not in rows.columns:
        rows = rows.withColumn("valid_from", F.current_timestamp())
    table.write(merge_assets(table.read(), rows))


def current_assets(assets: DataFrame, market_type: str | None = None, is_active: bool | None = None) -> DataFrame:
    found = assets.filter("valid_to IS NULL")
    if market_type:
        found = found.filter(F.col("market_type") == market_type)
    if is_active is not None:
        found = found.filter(F.col("is_active") == is_active)
    return found.orderBy("symbol")


def requested_assets(assets: DataFrame, symbols: DataFrame | list[str], market_type: str | None = None) -> DataFrame:
    """Current versions of the assets whose symbols are asked for (a list, or a frame with symbol); a listed symbol that is not there has no
    row."""
    if not isinstance(symbols, DataFrame):
        return current_assets(assets, market_type).filter(F.col("symbol").isin(symbols))
    return current_assets(assets, market_type).join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def log_experiments(table: Table, rows: DataFrame) -> None:
    """Appends rows, with any of the table's columns, as one version; ids that are there already, or twice among `rows`, are a ValueError."""
    held = table.read()
    new = rows.withColumn("created_at", F.coalesce("created_at", F.current_timestamp()) if "created_at" in rows.columns else F.current_timestamp())
    ids = held.select("experiment_id").unionByName(new.select("experiment_id")).groupBy("experiment_id").count().filter("count > 1")
    if twice := [r.experiment_id for r in ids.orderBy("experiment_id").limit(10).collect()]:
        raise ValueError(f"experiments {', '.join(twice)} exist")
    table.write(held.unionByName(new, allowMissingColumns=True))


def log_experiment(table: Table, row: dict) -> None:
    """Appends a row; an experiment_id that is there already is a ValueError. Metrics are kept as JSON."""
    row = {"created_at": None, **row}
    if isinstance(row.get("metrics"), dict):
        row["metrics"] = json.dumps(row["metrics"], sort_keys=True)
    held = table.read()
    if not held.filter(F.col("experiment_id") == row["experiment_id"]).isEmpty():
        raise ValueError(f"experiment {row['experiment_id']} exists")
    new = table.spark.createDataFrame([tuple(row.get(f.name) for f in EXPERIMENTS)], EXPERIMENTS)
    new = new.withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
    table.write(held.unionByName(new))


def experiments(table: Table) -> DataFrame:
    return table.read().orderBy(F.desc("created_at"))


def storage_summary(files: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Files, rows, bytes and megabytes (2 places), in all or by keys such as dataset_type."""
    mb = F.bround(F.coalesce(F.sum("size_bytes"), F.lit(0)) / 1048576.0, 2)
    aggs = [F.count("*").alias("file_count"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"), mb.alias("total_mb")]
    return files.groupBy(*keys).agg(*aggs) if keys else files.agg(*aggs)
