"""Small files in folders that Spark's file systems reach."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def at_path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is whole as soon as it has its name; one of that name is replaced."""
    fs, draft = at_path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    swap(spark, fs, draft, path)


def swap(spark: SparkSession, fs, draft, path: str) -> None:
    _, at = at_path(spark, path)
    if fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(draft, at):
        raise OSError(f"{path} could not be put in place")


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if it is not there."""
    fs, at = at_path(spark, path)
    return spark.read.text(path, wholetext=True).first()[0] if fs.exists(at) else None
