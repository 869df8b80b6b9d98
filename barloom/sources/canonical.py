"""Canonical tables: Parquet partitioned by market, symbol, dataset type, interval, year and month."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.time import as_timestamp

PARTITIONS = ("market", "symbol", "dataset_type", "interval", "year", "month")


def read(spark: SparkSession, path: str, schema: StructType | str | None = None, start_ms: int | None = None, end_ms: int | None = None, **equal) -> DataFrame:
    """Rows of a table (or glob) within a closed range of `timestamp`, filtered by equality on the keyword columns.

    Equalities on partition columns prune folders, the range is pushed to the scan. A path that matches nothing gives an empty
    frame of `schema`, if one is given; other errors are raised.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        frame = reader.parquet(path)
    except AnalysisException as error:
        if schema is None or "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    for name, value in equal.items():
        frame = frame.filter(F.col(name) == value)
    if start_ms is not None:
        frame = frame.filter(F.col("timestamp") >= start_ms)
    return frame if end_ms is None else frame.filter(F.col("timestamp") <= end_ms)


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a glob matches anything; False on any error."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))
    except Exception:
        return False


def with_provenance(frame: DataFrame, provenance: dict[str, str]) -> DataFrame:
    """`frame` whose timestamp column carries `provenance` as metadata, which Parquet keeps; what it has already wins."""
    held = dict(frame.schema["timestamp"].metadata)
    return frame.withColumn("timestamp", F.col("timestamp").alias("timestamp", metadata={**provenance, **held}))


def provenance(frame: DataFrame) -> dict[str, str]:
    return dict(frame.schema["timestamp"].metadata)


def write(frame: DataFrame, path: str, mode: str = "append", order: str = "timestamp") -> None:
    """Writes to the partitions that the frame's columns name; year and month come from `timestamp` if absent.

    Rows are dealt by the partition columns and sorted within, so a folder gets one file from each task that holds it.
    """
    for name, make in (("year", F.year), ("month", F.month)):
        if name not in frame.columns:
            frame = frame.withColumn(name, make(as_timestamp(F.col("timestamp"))))
    parts = [c for c in PARTITIONS if c in frame.columns]
    frame.repartition(*parts).sortWithinPartitions(*parts, order).write.mode(mode).option("compression", "snappy").partitionBy(*parts).parquet(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, sha256) of files; each file is one row, so files should be smaller than 2 GB."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def checksum_matches(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, ok): digests compared without case and without a sha256: prefix; a file that is missing is not ok."""
    wanted = expected.select("path", F.lower(F.trim(F.regexp_replace("sha256", "^sha256:", ""))).alias("_want"))
    return wanted.join(files, "path", "left").select("path", F.coalesce(F.lower("sha256") == F.col("_want"), F.lit(False)).alias("ok"))
