"""Helpers shared by the text operators: columns, checkpoints and Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import durable, fresh_dir, remove

__all__ = ["RUN_BYTES", "WORD_SEPARATORS", "SPACES", "table", "durable", "fresh_dir", "remove", "fresh_name", "bucket_of", "slices", "token_runs", "with_arrow_columns"]

#: The character classes that the operators' contracts name.
WORD_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` does not use yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of a column's text, modulo: the split that the classifiers' contracts fix. Null counts as empty."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


#: Bytes of text whose words are held at once.
RUN_BYTES = 4 << 20


def token_runs(data: bytes, size: int | None = None):
    """Lists of the tokens between spaces in `data`, one for each `size` bytes or so: long texts are never split whole."""
    size, at = size or RUN_BYTES, 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        if tokens := data[at:end].split():
            yield tokens
        at = end


#: Texts are worked on in slices of about this many bytes, however many rows an Arrow batch has.
SLICE_BYTES = 8 << 20


def slices(batch):
    """Arrow batches of about SLICE_BYTES each, with the same rows in the same order."""
    rows = batch.num_rows
    step = max(1, rows * SLICE_BYTES // max(batch.nbytes, 1)) if batch.nbytes > SLICE_BYTES else max(rows, 1)
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def with_arrow_columns(df: DataFrame, fields: str, make, keep: list[str] | None = None) -> DataFrame:
    """`df`'s `keep` columns (all by default) and the columns of `fields`, a DDL string, made from Arrow batches.

    `make()` runs once in each task and returns a function from a record batch to the new columns' arrays, in the
    order of `fields`. A column of `keep` that has the name of a new one is replaced.
    """
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(fields)
    new = {f.name.lower() for f in added}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    out = StructType([df.schema[c] for c in kept] + list(added))

    def run(batches):
        import pyarrow as pa

        work = make()
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + list(work(part)), names=[*kept, *added.names])

    return df.mapInArrow(run, out)
