"""From bars to windows, labels and baselines: all symbols in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import WindowSpec
from ..functions.vectors import flat, gaussian_projection
from ..operators import align, features, metrics, stats, windows
from ..storage import durable

#: Fixed value: places of the projected baseline.
DIMS = 256
TASKS = ("future_return", "volatility", "range_expansion", "liquidity")
#: The statistic behind each threshold task.
STATISTIC = {"volatility": "volatility", "range_expansion": "range", "liquidity": "volume"}


def training_windows(bars: DataFrame, funding: DataFrame | None, open_interest: DataFrame | None, spec: WindowSpec = WindowSpec(), style: str = "raw", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars and sparse modalities as windows ready for a loader."""
    state = align.market_state(bars, funding, open_interest, keys=keys)
    return windows.create_windows(features.build_features(state, style, keys), spec, keys)


def labelled_windows(bars: DataFrame, spec: WindowSpec, horizon_ms: int, budget_end_ms: int | None = None, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Windows with their statistics, handcrafted vector, future-return label and raw: their features in one row of numbers."""
    held = windows.window_stats(bars, spec, keys)
    found = windows.future_labels(held, bars, horizon_ms, budget_end_ms, keys).withColumn("handcrafted", windows.handcrafted_vector())
    whole = windows.create_windows(features.raw_features(bars), spec, keys)
    return found.join(whole.select(*keys, F.col("metadata.start_ts").alias("start_ts"), flat(F.col("features")).alias("raw")), [*keys, "start_ts"])


def task_labels(fit: DataFrame, frame: DataFrame, task: str) -> DataFrame:
    """`frame` with y: the future-return label, or whether the task's statistic is above the median of the fit rows."""
    if task == "future_return":
        return frame.withColumn("y", F.col("label"))
    name = STATISTIC[task]
    limit = stats.threshold_values(fit, [name])[name]
    return frame.withColumn("y", (F.col(name) > F.lit(limit).cast("double")).cast("int"))


def evaluate(fit: DataFrame, frame: DataFrame) -> DataFrame:
    """(task, baseline, balanced_accuracy, auc) of majority, persistence, and linear baselines on raw windows (raw_linear), their
    statistics (handcrafted_linear) and a projection of the raw windows to DIMS numbers (random_proj).

    Every task and model reads the same windows, so they are written once: a row for each window.
    """
    first = fit.select(F.size("raw")).first()
    width = first[0] if first else 0
    fit, frame = (durable(x.withColumn("projected", gaussian_projection(F.col("raw"), width, DIMS))) for x in (fit, frame))
    out = None
    for task in TASKS:
        a, b = task_labels(fit, fit, task), task_labels(fit, frame, task)
        top = stats.majority(a).first()["majority"]
        rows = metrics.evaluate_task(b, "y", top, task == "future_return").withColumn("auc", F.lit(None).cast("double"))
        for name, vector in (("raw_linear", F.col("raw")), ("handcrafted_linear", F.col("handcrafted")), ("random_proj", F.col("projected"))):
            pred = metrics.logistic(a.withColumn("embedding", vector), b.withColumn("embedding", vector))
            both = metrics.balanced_accuracy(pred, "y", "pred").join(metrics.roc_auc(pred, "y", "p1"))
            rows = rows.unionByName(both.select(F.lit(name).alias("baseline"), "balanced_accuracy", "auc"))
        rows = rows.withColumn("task", F.lit(task))
        out = rows if out is None else out.unionByName(rows)
    return out.select("task", "baseline", "balanced_accuracy", "auc")


def embed(frame: DataFrame, model, width: int, vector: str = "features") -> DataFrame:
    """`frame` with embedding: `model(list of vectors) -> array (rows, width)` on Arrow batches, on the executors."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    schema = StructType([*[f for f in frame.schema if f.name != "embedding"], StructField("embedding", ArrayType(DoubleType()))])

    def run(batches):
        for pdf in batches:
            yield pdf.assign(embedding=[list(map(float, v[:width])) for v in model(list(pdf[vector]))])

    return frame.mapInPandas(run, schema)
