"""How fast a loader's batches go through: counts observed on the running plan, and the time it took."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F




def capped_batches(frame: DataFrame, size: int, most: int | None = None) -> DataFrame:
    """(n): a row for each batch of `size` rows that a task makes of its own rows, the last one perhaps of fewer.

    With `most` there are that many in all at most: each task has an equal share and stops reading its input when that is used up, so
    no task waits for others. Shares of tasks with fewer rows are not passed on.
    """
    tasks = frame.rdd.getNumPartitions() if most is not None else 1

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        left = None if most is None else most // tasks + (TaskContext.get().partitionId() < most % tasks)
        held = 0
        if left == 0:
            return
        for batch in batches:
            held += batch.num_rows
            while held >= size:
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64())], names=["n"])
                held -= size
                if left is not None:
                    left -= 1
                    if not left:
                        return
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64())], names=["n"])

    return frame.mapInArrow(run, "n long")


def benchmark(frame: DataFrame, width: int, size: int = 32, most: int | None = 100, bytes_each: int = 4) -> dict[str, float]:
    """Samples, batches and bytes (of `width` numbers of `bytes_each` in each row) of one pass over `frame`, and their rates. Counts are
    an observation of the plan as it runs; nothing is collected. Of no rows all are 0.

    In a whole pass (no `most`) what tasks have left of fewer than `size` rows is counted as batches together, so there are as
    many as if one task had read all rows, however many tasks read them.
    """
    seen = Observation()
    whole = F.count_if(F.col("n") == size)
    batches = F.count("*") if most is not None else whole + F.ceil((F.coalesce(F.sum("n"), F.lit(0)) - whole * size) / size)
    counted = capped_batches(frame, size, most).observe(seen, batches.alias("batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("samples"))
    begun = time.perf_counter()
    counted.write.format("noop").mode("overwrite").save()
    seconds = max(time.perf_counter() - begun, 1e-4)
    batches, samples = seen.get["batches"], seen.get["samples"]
    n_bytes = samples * width * bytes_each
    rates = {"samples_per_sec": samples / seconds, "batches_per_sec": batches / seconds, "avg_batch_latency_ms": 1000 * seconds / batches if batches else 0.0, "mb_per_sec": n_bytes / seconds / (1 << 20)}
    return {"batches": batches, "samples": samples, "bytes": n_bytes, **(rates if batches else dict.fromkeys(rates, 0.0))}
