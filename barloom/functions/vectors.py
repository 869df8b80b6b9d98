"""Vectors as array columns, in higher-order functions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def cosine(a: Column, b: Column, epsilon: float = 1e-8) -> Column:
    """With `epsilon` added to each norm, so null vectors give 0."""
    return dot(a, b) / ((norm(a) + epsilon) * (norm(b) + epsilon))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def first_pooling(rows: Column) -> Column:
    return F.element_at(rows, 1)


def mean_pooling(rows: Column, mask: Column, width: int) -> Column:
    """The mean of the rows (an array of arrays) whose mask is true; zeros if none is."""
    kept = F.filter(F.arrays_zip(rows.alias("r"), mask.alias("m")), lambda x: x["m"])
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), width), lambda acc, x: F.zip_with(acc, doubles(x["r"]), lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def attention_pooling(rows: Column, mask: Column, query: list[float]) -> Column:
    """Rows weighed by the softmax, over the masked ones, of their products with `query` over the root of its width."""
    width = len(query)
    q = F.array(*[F.lit(float(x)) for x in query])
    kept = F.transform(F.filter(F.arrays_zip(rows.alias("r"), mask.alias("m")), lambda x: x["m"]), lambda x: doubles(x["r"]))
    scores = F.transform(kept, lambda r: dot(r, q) / width**0.5)
    weights = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = _sum(weights)
    parts = F.zip_with(kept, weights, lambda r, w: F.transform(r, lambda x: x * w))
    added = F.aggregate(parts, F.array_repeat(F.lit(0.0), width), lambda acc, r: F.zip_with(acc, r, lambda a, b: a + b))
    return F.when(F.size(kept) > 0, F.transform(added, lambda x: x / total)).otherwise(F.array_repeat(F.lit(0.0), width))


def flat(rows: Column) -> Column:
    return F.flatten(rows)


def minute_positions(times: Column, offset: int = 1) -> Column:
    """offset + whole minutes since the first time; position 0 is left to a summary token."""
    return F.transform(times, lambda t: F.lit(offset) + F.floor((t - F.element_at(times, 1)) / 60_000).cast("long"))


def gaussian_projection(v: Column, width: int, dims: int = 256, seed: int = 0) -> Column:
    """A seeded random projection to `dims` dimensions, over the root of `dims`. The matrix is made of the seed, so it is the
    same in each task, and drawn once there; it has width * dims numbers. Null vectors stay null."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<double>")
    def project(x):
        found, held = pd.Series([None] * len(x), dtype=object), x.notna().to_numpy()
        if held.any():
            rows = np.stack(x[held].to_list()) @ _matrix(width, dims, seed)
            found[held] = pd.Series(list(rows), index=np.flatnonzero(held), dtype=object)
        return found

    return project(doubles(v))


@lru_cache(maxsize=4)
def _matrix(width: int, dims: int, seed: int):
    import numpy as np

    return np.random.default_rng(seed).standard_normal((width, dims)) / np.sqrt(dims)
