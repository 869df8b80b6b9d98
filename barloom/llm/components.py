"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import durable

#: More rounds than this are a fault: the number grows with the logarithm of the largest component.
MOST_ROUNDS = 60
#: Rows of a few numbers that a task takes at least, once there is a task for each core.
TASK_ROWS = 100_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many tasks so many short rows are worth."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def _star(edges: DataFrame, tasks: int) -> DataFrame:
    """From each node, its larger neighbours are linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return moved.coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """From each node, it and its smaller neighbours are linked to the smallest of these. Edges are (larger, smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct().coalesce(tasks)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b), two columns of one ordered type; root is the smallest node.

    Each round is written to the shared folder, so lineage stays short. Minima are combined before each shuffle, so a node
    with very many neighbours costs a row per task there, and joins are plain equi-joins whose skew Spark can split. Tasks are as
    many as edges need, however many partitions a shuffle has: each leaves files behind, in each of some ten stages of a round.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    now = durable(ordered)
    mark = _mark(now)
    for _ in range(MOST_ROUNDS):
        tasks = tasks_for(edges.sparkSession, mark[0])
        now = durable(_small_star(_star(now, tasks), tasks))
        before, mark = mark, _mark(now)
        if mark == before:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct().coalesce(tasks)
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
    raise RuntimeError("connected components did not settle")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
