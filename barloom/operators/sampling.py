"""Seeded samples, shuffles, batches and masks: md5 stands for random numbers, so results depend neither on partitions nor engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered


def chance(seed: int, *of: str | Column) -> Column:
    """A number below 2**60 from the md5 of the seed and the texts of `of`, with colons between; nulls are left out."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in of])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def subsample(frame: DataFrame, n: int, ids: list[str], keys: list[str] | None = None, seed: int = 0) -> DataFrame:
    """At most n rows (for each key), all subsets being as likely; the rows' own order is that of `ids`."""
    drawn = chance(seed, *ids)
    if not keys:
        return frame.orderBy(drawn, *ids).limit(n)
    return frame.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(drawn, *ids))).filter(F.col("_r") <= n).drop("_r")


def epoch_order(frame: DataFrame, ids: list[str], seed: int, epoch: int) -> DataFrame:
    """`frame` sorted in an order of its own for each epoch: a range sort by hash."""
    return frame.orderBy(chance(seed + epoch, *ids), *ids)


def batches(frame: DataFrame, size: int, order: list, drop_last: bool = False) -> DataFrame:
    """`frame` with batch, numbered in `order` (names, or a column first); drop_last leaves out a last batch that is not full."""
    rows = frame.withColumn("_o", order[0] if isinstance(order[0], Column) else F.col(order[0]))
    rows = numbered(rows, "_o", *order[1:]).withColumn("batch", F.floor(F.col("_n") / size).cast("long"))
    if drop_last:
        rows = rows.filter(F.col("batch") < rows.count() // size)
    return rows.drop("_o", "_n")


def random_mask(length: Column, ratio: float, key: Column, seed: int = 0) -> Column:
    """An array of booleans: the ratio * length places, and one more, with the smallest hashes."""
    drawn = F.transform(F.sequence(F.lit(0), length - 1), lambda i: chance(seed, key, i))
    limit = F.element_at(F.array_sort(drawn), F.least(F.floor(length * ratio) + 1, length).cast("int"))
    return F.when(length > 0, F.transform(drawn, lambda x: x <= limit)).otherwise(F.array().cast("array<boolean>"))


def span_mask(length: Column, ratio: float, span: int, key: Column, seed: int = 0) -> Column:
    """An array of booleans with spans of `span` masked places, one in each of ratio * length / span equal strata."""
    count = F.greatest(F.floor(length * ratio / span), F.lit(1)).cast("int")
    width = F.greatest(F.floor(length / count), F.lit(1)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda s: s * width + chance(seed, key, s) % F.greatest(width - span + 1, F.lit(1)))
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.exists(starts, lambda s: (i >= s) & (i < s + span)))
