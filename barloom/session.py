"""Session settings that the library's results rely on (UTC) or profit from (adaptive execution)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "barloom", master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    """A session; cluster settings such as the master are left to spark-submit unless given."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in more.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the session's executors, once, for where they cannot import it from a path of their own."""
    import shutil
    import tempfile
    from pathlib import Path

    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        with tempfile.TemporaryDirectory(prefix="barloom-") as scratch:
            copy = Path(scratch) / "package" / package.name
            shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
            keep = tempfile.mkdtemp(prefix="barloom-")
            context.addPyFile(shutil.make_archive(f"{keep}/{package.name}", "zip", copy.parent, package.name))
        _shipped.add(context.applicationId)
    return spark
