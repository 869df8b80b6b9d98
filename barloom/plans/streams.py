"""Running a streaming plan over what is there now."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_dir, remove

#: Rows of a batch of a stream that is fed in the order of time.
FEED_ROWS = 2_000_000
#: Rows of an Arrow batch of a stream. Spark sends a key's state along with each batch of its rows, so small ones send it many times.
ARROW_ROWS = 200_000
#: Tasks of a batch of bounded size, or one for each core if these are more. Each starts a worker and keeps a state, though it has no row.
STATE_TASKS = 16


def in_time_order(rows: DataFrame, time: str, out: str, feed_rows: int | None = None) -> int:
    """Writes `rows` under `out` as files of some FEED_ROWS rows, each later in `time` than the one before and written after it, which is
    how a stream of files orders them. How many there are. Rows of one time share a file.

    All rows are dealt in one job; then each file is copied by itself, so every row is read twice however many files there are."""
    n = max(1, -(-rows.count() // (feed_rows or FEED_ROWS)))
    if n == 1:
        rows.coalesce(1).write.parquet(f"{out}/part={0:06}")
        return n
    rows.repartitionByRange(n, time).withColumn("_file", F.spark_partition_id()).write.partitionBy("_file").parquet(f"{out}-dealt")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.sparkSession.read.schema(f"{kinds}, _file int").parquet(f"{out}-dealt")
    for i in range(n):
        dealt.filter(F.col("_file") == i).drop("_file").coalesce(1).write.parquet(f"{out}/part={i:06}")
    remove(rows.sparkSession, f"{out}-dealt")
    return n


def available_now(
    spark: SparkSession, folder: str, name: str, plan: Callable[[DataFrame], DataFrame], mode: str = "append", time: str | None = None, columns: Sequence[str] = ()
) -> DataFrame:
    """The result of `plan` on a stream of the table's files, as a batch frame.

    With `time` the table is fed in the order of that column, a file of bounded size for each batch: the watermark follows, so plans
    that hold rows until it has passed them hold two batches' rows and not the table's, and no row is late. With `columns` the stream
    has only these.

    Result and checkpoint lie in the shared folder that spark.checkpoint.dir names. In complete mode the last batch is whole; in
    append mode batches are added, each under its own number, so a batch that runs again replaces itself.
    """
    out = fresh_dir(spark, "stream")
    static = spark.read.parquet(f"{folder}/{name}.parquet")
    static = static.select(*columns) if columns else static
    reader = spark.readStream.schema(static.schema).option("pathGlobFilter", "*.parquet")
    if time:
        in_time_order(static, time, f"{out}-feed")
        source = reader.option("maxFilesPerTrigger", 1).parquet(f"{out}-feed/part=*")
    else:
        source = reader.parquet(f"{folder}/{name}.parquet*")
    result = plan(source)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{'whole' if mode == 'complete' else f'batch={number}'}")

    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": ARROW_ROWS}
    if time:
        settings["spark.sql.shuffle.partitions"] = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(STATE_TASKS, spark.sparkContext.defaultParallelism))
    before = {setting: spark.conf.get(setting) for setting in settings}
    try:
        for setting, value in settings.items():  # a stream keeps the settings that it starts with
            spark.conf.set(setting, str(value))
        stream = result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value)
    stream.awaitTermination()
    if time:
        remove(spark, f"{out}-feed")
    found = spark.read.schema(result.schema).parquet(f"{out}/{'whole' if mode == 'complete' else '*'}")
    return found
