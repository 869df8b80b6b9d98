"""Ranks over all rows without a task that holds them: values counted, sorted by range, and counted up in two levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable


def ranged(frame: DataFrame, *order: str, slot: str = "_slot") -> DataFrame:
    """`frame` with a slot that never falls along `order`, cut by sampled quantiles so that slots have like numbers of rows.

    Rows that are equal in `order` share a slot. It is written once, as a range partitioning made anew may be cut elsewhere.
    """
    return durable(frame.repartitionByRange(*order).withColumn(slot, F.spark_partition_id()))


def numbered(frame: DataFrame, *order: str, name: str = "_n") -> DataFrame:
    """`frame` with each row's number, from 0, in the order of all rows. Rows equal in `order` are numbered in any order."""
    rows = ranged(frame, *order)
    ahead = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_slot").agg(F.count("*").alias("_k")).select("_slot", F.coalesce(F.sum("_k").over(ahead), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_slot").orderBy(*order)) - 1
    return rows.withColumn("_place", place).join(before, "_slot").withColumn(name, F.col("_before") + F.col("_place")).drop("_slot", "_before", "_place")


def order_statistics(frame: DataFrame, columns: list[str], shares: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, column, share, n, disc, cont) of the values of each column that are not null, for each of `keys` if there are any: the
    exact quantile as the first value at or above the share, and interpolated. What has no values has no row.

    Values are counted on the map side, the distinct ones are dealt by range of key, column and value, and a target is looked up
    by the counts of the slots before it: what one task holds is its range, so many keys share a slot and a large key has many.
    Null keys are keys.
    """
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    # Structs compare as equal where both have a null.
    own = F.struct(F.lit(0).alias("_"), *keys).alias("_key")
    counts = frame.select(own, F.explode(values).alias("v")).select("_key", "v.*").filter("value IS NOT NULL").groupBy("_key", "column", "value").agg(F.count("*").alias("k"))
    rows = ranged(counts, "_key", "column", "value")
    of = ["_key", "column"]
    ahead = Window.partitionBy(*of).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*of)
    slots = rows.groupBy(*of, "_slot").agg(F.sum("k").alias("k"))  # a row for each key and column and each range that has some of it
    slots = slots.select(*of, "_slot", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("before"), F.sum("k").over(every).alias("n"), (F.coalesce(F.sum("k").over(ahead), F.lit(0)) + F.col("k")).alias("after"))
    wanted = slots.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    place = F.col("share") * (F.col("n") - 1)
    ranks = [F.greatest(F.ceil(F.col("share") * F.col("n")) - 1, F.lit(0)), F.floor(place), F.ceil(place)]
    # Only slots that hold a wanted rank are counted through: three ranks for each key, column and share.
    hit = wanted.select(*of, "_slot", "before", "after", "share", "n", (place - F.floor(place)).alias("part"), F.posexplode(F.array(*[r.cast("long") for r in ranks])).alias("which", "rank"))
    hit = hit.filter("rank >= before AND rank < after").drop("after")
    inside = Window.partitionBy(*of, "_slot").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("upto", F.sum("k").over(inside)).join(hit if keys else F.broadcast(hit), [*of, "_slot"])
    found = found.filter((F.col("rank") < F.col("before") + F.col("upto")) & (F.col("rank") >= F.col("before") + F.col("upto") - F.col("k")))
    low, high = (F.max(F.when(F.col("which") == i, F.col("value"))) for i in (1, 2))
    found = found.groupBy(*of, "share", "n", "part").agg(F.max(F.when(F.col("which") == 0, F.col("value"))).alias("disc"), low.alias("low"), high.alias("high"))
    return found.select(*[F.col(f"_key.{k}").alias(k) for k in keys], "column", "share", "n", "disc", (F.col("low") + F.col("part") * (F.col("high") - F.col("low"))).alias("cont"))
