"""Nearest neighbours by cosine, exactly and through an inverted file of cells.

Rows meet in blocks: a key has some queries and some rows, whose products are matrix products of a few queries at a time; each
query keeps its k best of a block, so what leaves a block is k rows for each query and no row for each pair. How many blocks
there are follows from counts: blocks grow with the rows, so that each row is sent SIDES times and what is moved grows as the
rows do, until a block has BLOCK_ROWS * MOST_BLOCKS of them. Without an index all rows are one cell; with one, queries meet the cells that are nearest
to them, and, for an exact answer, every other cell that may hold something nearer than what was found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.vectors import doubles
from ..storage import durable

BLOCK_ROWS = 1_024
#: More than BLOCK_ROWS rows are so many blocks on each side, or BLOCKS in all for few queries; a block has BLOCK_ROWS times MOST_BLOCKS at most.
SIDES, BLOCKS, MOST_BLOCKS = 8, 64, 64
#: Products that are held at once.
PRODUCTS = 1 << 22
#: Cells are fitted on at most so many rows, those with the smallest hashes of their ids, and every row is filed.
SAMPLE_ROWS, MOST_CELLS, ROUNDS = 32_768, 4_096, 8
#: Similarities are compared to so many places, so that products of another order of sums tie alike.
PLACES = 12


def _units(column) -> np.ndarray:
    """An Arrow column of vectors as rows of length one; zeros stay."""
    rows = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    found = np.asarray(rows.flatten(), np.float64).reshape(len(rows), -1)
    return found / (np.linalg.norm(found, axis=1, keepdims=True) + 1e-12)


def _rows(frame: DataFrame, vec_id: str, vector: str, name: str, *more: Column) -> DataFrame:
    v = F.col(vector) if frame.schema[vector].dataType == ArrayType(FloatType()) else doubles(F.col(vector))  # floats take half the room on their way
    return frame.select(F.col(vec_id).alias(name), v.alias("v"), *more).filter(F.col(name).isNotNull() & F.col("v").isNotNull())


def _bounds(near: np.ndarray, k: int) -> np.ndarray:
    """For each row a bound that its k largest values reach and few others do: the k-th largest of what groups of columns have as their
    largest."""
    n = near.shape[1]
    if n <= k:
        return np.full(len(near), -2.0)
    width = max(1, n // (8 * k))
    tops = near[:, : n - n % width].reshape(len(near), -1, width).max(axis=2)
    return np.partition(tops, -k, axis=1)[:, -k]


def parts_of(rows: Column, block_rows: int, most: Column | int = SIDES) -> Column:
    """Into how many parts so many rows are cut: of `block_rows` each, but `most` in all while parts are not too large."""
    held = F.least(F.ceil(rows / block_rows), F.lit(most) if isinstance(most, int) else most)
    return F.greatest(held, F.ceil(rows / (block_rows * MOST_BLOCKS))).cast("long")


def _best(k: int):
    """For queries and rows of one key: each query's k best rows."""

    def meet(key, left, right):
        import pyarrow as pa

        right = right.sort_by("neighbour")  # then an earlier column of the product is a smaller id
        base = _units(right["v"]).T if len(right) else None
        found = []
        step = max(1, min(512, PRODUCTS // max(len(right), 1)))
        for at in range(0, len(left) if len(right) else 0, step):
            part = left.slice(at, step)
            near = _units(part["v"]) @ base
            own = np.asarray(pa.compute.index_in(part["query"], right["neighbour"]).fill_null(-1))
            near[np.flatnonzero(own >= 0), own[own >= 0]] = -np.inf
            row, col = np.nonzero(near >= np.maximum(_bounds(near, k) - 2 * 10.0**-PLACES, -2.0)[:, None])
            values = np.round(near[row, col], PLACES)
            order = np.lexsort((col, -values, row))
            row, col, values = row[order], col[order], values[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col, values = row[kept], col[kept], values[kept]
            found.append(pa.table([pa.array([key[0].as_py()] * len(row), key[0].type), part["query"].take(pa.array(row)), right["neighbour"].take(pa.array(col)), pa.array(values)], names=["cell", "query", "neighbour", "similarity"]))
        return pa.concat_tables(found) if found else pa.table({"cell": pa.array([], key[0].type), "query": left["query"].slice(0, 0), "neighbour": right["neighbour"].slice(0, 0), "similarity": pa.array([], pa.float64())})

    return meet


def _met(asked: DataFrame, filed: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(cell, query, neighbour, similarity): the k best of each block for each query, `asked` (query, v, cell) and `filed` (neighbour, v, cell).

    A cell with many rows, or asked by many queries, is as many blocks as it needs. Cells are few: their counts are broadcast.
    """
    counts = asked.select("cell", F.lit(1).alias("q"), F.lit(0).alias("b")).unionByName(filed.select("cell", F.lit(0).alias("q"), F.lit(1).alias("b"))).groupBy("cell").agg(F.sum("q").alias("q"), F.sum("b").alias("b")).filter("q > 0 AND b > 0")
    counts = counts.withColumn("qs", parts_of(F.col("q"), block_rows))
    counts = counts.withColumn("bs", parts_of(F.col("b"), block_rows, F.greatest(F.lit(SIDES), F.floor(F.lit(BLOCKS) / F.col("qs")))))
    counts = F.broadcast(durable(counts.select("cell", "qs", "bs")))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = asked.join(counts, "cell").select("query", "v", "cell", F.pmod(F.xxhash64("query"), F.col("qs")).alias("qp"), every("bs").alias("bp"))
    right = filed.join(counts, "cell").select("neighbour", "v", "cell", F.pmod(F.xxhash64("neighbour"), F.col("bs")).alias("bp"), every("qs").alias("qp"))
    keys = ["cell", "qp", "bp"]
    kinds = {f.name: f.dataType.simpleString() for f in (*asked.schema, *filed.schema)}
    schema = f"cell {kinds['cell']}, query {kinds['query']}, neighbour {kinds['neighbour']}, similarity double"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best(k), schema)


def _ranked(found: DataFrame, k: int, *of: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*of, "query").orderBy(F.desc("similarity"), "neighbour"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(*of, "query", "neighbour", "similarity", "rank")


def neighbours(queries: DataFrame, base: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", within: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(within, query, neighbour, similarity, rank): for each query the k nearest of `base` by cosine, itself left out; ties go to the
    smaller id. Exact: every query meets every row, in blocks; with `within`, every row that is equal in these columns.

    Ids are distinct (in each group) and of any ordered type. Rows without an id or a vector take no part; vectors of zeros are at
    0 from all. Fewer than k other rows give fewer neighbours. An empty side gives an empty result.
    """
    asked, filed = (_rows(x, vec_id, vector, name, *within).withColumn("cell", F.pmod(F.xxhash64(*within or (name,)), F.lit(1 if not within else 1 << 62))) for x, name in ((queries, "query"), (base, "neighbour")))
    found = _ranked(_met(asked, filed, k, block_rows), k, *(["cell"] if within else []))
    if not within:
        return found
    names = queries.select(*within).distinct().withColumn("cell", F.pmod(F.xxhash64(*within), F.lit(1 << 62)))
    return found.join(names, "cell").select(*within, "query", "neighbour", "similarity", "rank")


@dataclass
class CellIndex:
    """rows: neighbour, v and cell of every row that was filed. centres: a unit vector for each cell. nearness: of each cell, the
    least cosine of a row with its centre; 2 where it has no row."""

    rows: DataFrame
    centres: np.ndarray
    nearness: np.ndarray


def _with_cells(frame: DataFrame, centres: np.ndarray, fields: str, choose) -> DataFrame:
    """`frame` and columns made of its vectors' cosines with all centres, a matrix for each Arrow batch."""
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(fields)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([*part.columns, *choose(_units(part["v"]) @ centres.T, part)], names=[*part.schema.names, *added.names])

    return frame.mapInArrow(run, StructType([*frame.schema, *added]))


def _lists(chosen: np.ndarray):
    """Rows of truths as an Arrow column of the places that are true."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(chosen.sum(axis=1))), pa.int32()), pa.array(np.nonzero(chosen)[1], pa.int32()))


def build_index(base: DataFrame, cells: int | None = None, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 0) -> CellIndex:
    """Files every row of `base` under its nearest centre. Centres are those of a spherical k-means on the bounded sample; there
    are as many as the root of the rows, and MOST_CELLS at most, unless given."""
    import pyarrow as pa

    rows = _rows(base, vec_id, vector, "neighbour")
    n = rows.count()
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "neighbour"), "neighbour").limit(SAMPLE_ROWS).select("v").toArrow()
    if not n:
        return CellIndex(rows.withColumn("cell", F.lit(0)), np.zeros((0, 0)), np.zeros(0))
    units = _units(sample["v"])
    cells = max(1, min(cells or round(n**0.5), MOST_CELLS, len(units)))
    centres = units[:cells]  # the sample is in random order
    for _ in range(ROUNDS):
        near = np.argmax(units @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, units)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1), centres)

    def nearest(cosines, part):
        cell = cosines.argmax(axis=1)
        return [pa.array(cell, pa.int32()), pa.array(cosines[np.arange(len(cell)), cell])]

    filed = durable(_with_cells(rows, centres, "cell int, cosine double", nearest))
    nearness = np.full(cells, 2.0)
    for r in filed.groupBy("cell").agg(F.min("cosine").alias("least")).collect():  # a row for each cell
        nearness[r.cell] = r.least
    return CellIndex(filed.drop("cosine"), centres, nearness)


def search(index: CellIndex, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False, vec_id: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """As `neighbours`, of the rows in the `probes` cells whose centres are nearest to each query.

    With `exact` each query then meets all other cells that may hold a row as near as its k-th: by the triangle of angles, those
    whose angle from the query less their widest is not wider. Then the result is that of `neighbours`.
    """
    import pyarrow as pa

    asked = _rows(queries, vec_id, vector, "query")
    if not len(index.centres):
        return _ranked(asked.withColumn("cell", F.lit(0)).join(index.rows, "cell").select("query", "neighbour", F.lit(0.0).alias("similarity")), k)
    probes = min(probes, len(index.centres))

    def first(cosines):
        chosen = np.zeros(cosines.shape, bool)
        np.put_along_axis(chosen, np.argsort(-cosines, axis=1, kind="stable")[:, :probes], True, axis=1)
        return chosen

    def meet(rows: DataFrame, choose) -> DataFrame:
        at = _with_cells(rows, index.centres, "cells array<int>", lambda cosines, part: [_lists(choose(cosines, part))])
        return _met(at.select("query", "v", F.explode("cells").alias("cell")), index.rows, k, block_rows)

    found = durable(meet(asked, lambda cosines, part: first(cosines)))
    if exact:
        kth = _ranked(found, k).filter(F.col("rank") == k).select("query", F.col("similarity").alias("least"))
        nearness = index.nearness
        widest = np.arccos(np.clip(nearness, -1, 1))

        def others(cosines, part):
            least = np.asarray(part["least"].fill_null(-2.0), np.float64)
            angle = np.arccos(np.clip(cosines, -1, 1))
            most = np.where(nearness > 1, -3.0, np.cos(np.maximum(angle - widest, 0)))
            return (most + 1e-7 >= least[:, None]) & (most > -3) & ~first(cosines)

        found = found.unionByName(meet(asked.join(kth, "query", "left"), others))
    return _ranked(found, k)


#: Rows whose true neighbours are looked for in the cells, to learn how many cells must be met, and the share of neighbours to be found.
TRIAL_ROWS, TRIAL_SHARE = 1_024, 0.95


def enough_probes(index: CellIndex, k: int = 10, share: float = TRIAL_SHARE, rows: int = TRIAL_ROWS, seed: int = 0) -> int:
    """How many cells a query must meet first for `share` of its k nearest rows, as learned from at most `rows` rows of the index, those
    with the smallest hashes of their ids: their exact neighbours' cells are counted in the order in which a query meets cells.

    Vectors without clusters need most cells, however many there are; a count that is fixed finds fewer neighbours in a larger table.
    """
    if not len(index.centres):
        return 1
    held = index.rows.select(F.col("neighbour").alias("id"), "v", "cell")
    trial = durable(held.drop("cell").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(rows))
    near = neighbours(trial, held, k, "id", "v").select("query", "neighbour").join(held.select(F.col("id").alias("neighbour"), "cell"), "neighbour")
    asked = near.groupBy("query").agg(F.collect_list("cell").alias("at")).join(trial.withColumnRenamed("id", "query"), "query")

    def places(cosines, part):
        import pyarrow as pa

        rank = np.argsort(np.argsort(-cosines, axis=1, kind="stable"), axis=1)
        at = part["at"]
        row = np.repeat(np.arange(len(at)), np.diff(np.asarray(at.offsets)))
        return [pa.ListArray.from_arrays(pa.array(np.asarray(at.offsets) - at.offsets[0].as_py(), pa.int32()), pa.array(rank[row, np.asarray(at.flatten())] + 1, pa.int32()))]

    met = _with_cells(asked, index.centres, "places array<int>", places).select(F.explode("places").alias("place"))
    counts = sorted((r.place, r["count"]) for r in met.groupBy("place").count().collect())  # a row for each cell at most
    wanted, held_by = share * sum(n for _, n in counts), 0
    for place, n in counts:
        held_by += n
        if held_by >= wanted:
            return place
    return 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: recall, the share of the pairs of `exact` (query, neighbour) that `found` has, and pairs, how many there are."""
    both = exact.select("query", "neighbour").join(found.select("query", "neighbour", F.lit(1).alias("hit")), ["query", "neighbour"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"), F.count("*").alias("pairs"))
