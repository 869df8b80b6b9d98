"""Embeddings of windows: an encoder runs once over Arrow batches, and every pooling is taken of what it gives."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

#: The names of the poolings.
POOLINGS = ("cls", "mean", "attention")
#: Windows that an encoder gets at once.
BATCH = 512


def check_poolings(poolings: list[str] | tuple[str, ...]) -> None:
    """ValueError if any of `poolings` is none that there is."""
    if unknown := sorted(set(poolings) - set(POOLINGS)):
        raise ValueError(f"unknown poolings {', '.join(map(str, unknown))}; there are {', '.join(POOLINGS)}")


def pool(latent: np.ndarray, mask: np.ndarray, poolings: tuple[str, ...], query: np.ndarray | None) -> list[np.ndarray]:
    """For each pooling, rows of `latent` (windows, 1 + steps, width), whose first step stands for the whole window; `mask` (windows,
    steps) says which others count. Windows in which none does have zeros as mean and attention."""
    steps, n = latent[:, 1:], np.maximum(mask.sum(axis=1, keepdims=True), 1)
    found = []
    for kind in poolings:
        if kind == "cls":
            found.append(latent[:, 0])
        elif kind == "mean":
            found.append((steps * mask[:, :, None]).sum(axis=1) / n)
        else:
            scores = np.where(mask, steps @ query / np.sqrt(latent.shape[2]), -np.inf)
            top = scores.max(axis=1, keepdims=True)
            weights = np.exp(scores - np.where(np.isfinite(top), top, 0))
            total = weights.sum(axis=1, keepdims=True)
            found.append((steps * (weights / np.where(total > 0, total, 1))[:, :, None]).sum(axis=1))
    return found


def pooled_embeddings(windows: DataFrame, encoder: Callable[[np.ndarray, np.ndarray], np.ndarray], poolings: list[str] | tuple[str, ...] = POOLINGS, keep: tuple[str, ...] = ("symbol",), query: list[float] | None = None) -> DataFrame:
    """(keep, pooling, embedding): a row for each window and pooling, in the order of the windows and then of `poolings`.

    `windows` has features (steps of numbers; all of one length) and mask. `encoder(features, mask)` gets float arrays (windows, steps,
    features) and (windows, steps) and gives (windows, 1 + steps, width). It runs once for all poolings, on executors. `query` is
    what attention weighs steps by; ones if not given. Unknown poolings are a ValueError; features that are null count as 0.
    """
    check_poolings(poolings)
    poolings = tuple(poolings)
    schema = StructType([*[windows.schema[c] for c in keep], StructField("pooling", StringType()), StructField("embedding", ArrayType(DoubleType()))])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                features = np.array(part.column("features").to_pylist(), dtype=float)
                mask = np.array(part.column("mask").to_pylist(), dtype=bool)
                latent = np.asarray(encoder(np.nan_to_num(features), mask), float)
                own = np.ones(latent.shape[2]) if query is None else np.asarray(query, float)
                found = np.stack(pool(latent, mask, poolings, own), axis=1).reshape(-1, latent.shape[2])
                rows = pa.array(np.repeat(np.arange(part.num_rows), len(poolings)))
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * latent.shape[2], pa.int32()), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(rows) for c in keep], pa.array(list(poolings) * part.num_rows), values], names=schema.names)

    return windows.select(*keep, "features", "mask").mapInArrow(run, schema)
