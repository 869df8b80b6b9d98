"""Statistics of columns, and normalisers fitted on observed values of the fit split."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import numbers as N
from .ranks import order_statistics


def numeric_columns(frame: DataFrame) -> list[str]:
    return [f.name for f in frame.schema if isinstance(f.dataType, NumericType)]


def describe(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, min, max, mean, std) of numeric columns, nulls left out; std is the sample's, 0 for one value. Columns without a
    value have no row. One aggregation for all columns."""
    columns = numeric_columns(frame) if columns is None else columns
    if not columns:
        return frame.sparkSession.createDataFrame([], "column string, min double, max double, mean double, std double")
    wide = frame.agg(*[F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.avg(c).alias("mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std")).alias(f"c{i}") for i, c in enumerate(columns)])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("s")) for i, c in enumerate(columns)])
    return wide.select(F.explode(entries).alias("e")).select("e.column", "e.s.*").filter("mean IS NOT NULL")


def zscore_fit(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, std): the sample deviation of observed values; 0 becomes 1, and of a single value it stays null."""
    aggs = [F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(f"c{i}") for i, c in enumerate(columns)]
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("s")) for i, c in enumerate(columns)])
    rows = frame.agg(*aggs).select(F.explode(entries).alias("e")).select("e.column", "e.s.*")
    return rows.withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def robust_fit(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(column, median, iqr): the lower median and interpolated quartiles of observed values. An iqr of 0 becomes 1; fewer than
    two values give (0, 1)."""
    found = order_statistics(frame, columns, [0.25, 0.5, 0.75])

    def at(share: float, kind: str) -> Column:
        return F.max(F.when(F.col("share") == share, F.col(kind)))

    found = found.groupBy("column").agg(at(0.5, "disc").alias("median"), (at(0.75, "cont") - at(0.25, "cont")).alias("iqr"), F.max("n").alias("n"))
    names = frame.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("column"))
    few = F.coalesce(F.col("n"), F.lit(0)) < 2
    return names.join(found, "column", "left").select("column", F.when(few, 0.0).otherwise(F.col("median")).alias("median"), F.when(few | (F.col("iqr") == 0), 1.0).otherwise(F.col("iqr")).alias("iqr"))


class Normalizer:
    """zscore, robust or log; statistics are a few numbers for each column, held on the driver."""

    def __init__(self, mode: str = "zscore"):
        if mode not in ("zscore", "robust", "log"):
            raise ValueError(f"unknown mode {mode!r}")
        self.mode, self.stats = mode, None

    def fit(self, frame: DataFrame, columns: list[str]) -> Normalizer:
        rows = (robust_fit if self.mode == "robust" else zscore_fit)(frame, columns).collect()
        self.stats = {r["column"]: {k: v for k, v in r.asDict().items() if k != "column"} for r in rows}
        return self

    def _fitted(self) -> dict:
        if self.stats is None:
            raise RuntimeError("the normalizer has not been fitted")
        return self.stats

    def column(self, name: str) -> Column:
        s, x = self._fitted()[name], F.col(name)
        if self.mode == "log":
            return N.log_transform(x)
        if self.mode == "robust":
            return N.robust(x, F.lit(s["median"]), F.lit(s["iqr"]))
        return N.zscore(x, F.lit(s["mean"]), F.lit(s["std"]))

    def transform(self, frame: DataFrame) -> DataFrame:
        return frame.withColumns({c: self.column(c) for c in self._fitted() if c in frame.columns})

    def dumps(self) -> str:
        return json.dumps({"mode": self.mode, "stats": self._fitted()}, indent=2)

    def save(self, path: str | Path) -> None:
        Path(path).write_text(self.dumps())

    @classmethod
    def load(cls, path: str | Path) -> Normalizer:
        return cls.loads(Path(path).read_text())

    @classmethod
    def loads(cls, text: str) -> Normalizer:
        held = json.loads(text)
        found = cls(held.get("mode", "zscore"))
        found.stats = held["stats"]
        return found


def thresholds(frame: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Exact medians (the mean of the middle two) of each column: `<column>_threshold`. One row, or one for each of `keys`, null
    keys included."""
    medians = [F.max(F.when(F.col("column") == c, F.col("cont"))).alias(f"{c}_threshold") for c in columns]
    found = order_statistics(frame, columns, [0.5], tuple(keys or ()))
    if not keys:
        return found.agg(*medians)
    names = [f"_{k}" for k in keys]
    held = frame.select(*keys).distinct().toDF(*names)
    same = F.struct(*keys) == F.struct(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)])
    return held.join(found.groupBy(*keys).agg(*medians), same, "left").select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], *[f"{c}_threshold" for c in columns])


def threshold_values(frame: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The medians as numbers on the driver, one for each column."""
    return {c: v for c, v in zip(columns, thresholds(frame, columns).first(), strict=True)}


def majority(frame: DataFrame, label: str = "y") -> DataFrame:
    """One row: the most frequent class (of equals the smallest) and the mean label; 0 and 0 of no rows."""
    counts = frame.groupBy(label).agg(F.count("*").alias("n"))
    best = counts.agg(F.max_by(label, F.struct("n", (-F.col(label)).alias("neg"))).alias("majority"), (F.sum(F.col(label) * F.col("n")) / F.sum("n")).alias("p1"))
    return best.select(F.coalesce("majority", F.lit(0)).cast("int").alias("majority"), F.coalesce("p1", F.lit(0.0)).cast("double").alias("p1"))
