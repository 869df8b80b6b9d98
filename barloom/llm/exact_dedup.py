"""Exact dedup on an extendible-hash index kept in the shared folder. DataFrame operations only.

Keys are 64-bit hashes of normalised texts. The directory starts with a bucket for each core; while a bucket holds more
distinct keys than CAPACITY, the directory doubles and the bucket is split by its next hash bit. A bucket is a range of
keys with one owner task. What is dealt to owners is an entry for each text and original length, combined where rows lie
before it is shuffled, and the bytes of texts whose key several rows have. The owner chains entries of equal keys, tells
them apart by length and digest, compares their bytes, decides which row stays and writes its bucket as a file. Rows look
their entry up in the bucket that the directory names.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACES, durable, fresh_dir, fresh_name, table

#: Distinct keys of a bucket; an entry has about 150 bytes, and the bytes of a text that has copies.
CAPACITY = 200_000
#: Keys of 8 bytes that may be broadcast.
BROADCAST_KEYS = 1_000_000
#: Rows of about 100 bytes that may be broadcast: rows that go, cells of a directory.
BROADCAST_ROWS = 100_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def key_of(bare: Column) -> Column:
    return F.xxhash64(bare)


def digest_of(bare: Column) -> Column:
    return F.sha2(bare.cast("binary"), 256)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_points (code points of the original), key, n_bytes and text_sha256 of the normalised text, row (a number)."""
    bare = docs.select(F.col(doc_id).alias("doc_id"), F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_points"), normalised(F.col(text)).alias("bare"))
    return bare.select("doc_id", "n_points", key_of(F.col("bare")).alias("key"), F.octet_length("bare").cast("long").alias("n_bytes"), digest_of(F.col("bare")).alias("text_sha256"), F.monotonically_increasing_id().alias("row"))


@dataclass
class Directory:
    """buckets: (prefix, local depth) in the order of keys; a bucket has the keys whose first `local depth` bits are prefix.

    Its rows number the buckets, which are few: one for each core, or each CAPACITY / 2 keys or so.
    """

    buckets: list[tuple[int, int]]

    @property
    def depth(self) -> int:
        return max(local for _, local in self.buckets)

    def cells(self, spark: SparkSession) -> DataFrame:
        """(cell, bucket): the directory's 2**depth slots, made by tasks."""
        depth = self.depth
        rows = json.dumps([{"first": prefix << (depth - local), "width": 1 << (depth - local), "bucket": i} for i, (prefix, local) in enumerate(self.buckets)])
        held = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<first:bigint,width:bigint,bucket:int>>")))
        found = held.select(F.explode(F.sequence("first", F.col("first") + F.col("width") - 1)).alias("cell"), "bucket")
        return F.broadcast(found) if 1 << depth <= BROADCAST_ROWS else found

    def place(self, rows: DataFrame) -> DataFrame:
        """`rows` (with `key`) and `bucket`, looked up by the key's first bits."""
        return rows.withColumn("cell", cell_of("key", self.depth)).join(self.cells(rows.sparkSession), "cell").drop("cell")


def cell_of(key: str, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def grown(keys: DataFrame, capacity: int = CAPACITY, depth: int = 0) -> Directory:
    """The directory of distinct `keys`, begun with 2**depth buckets and doubled while one holds more than `capacity`.

    In each round the cells' counts reach the driver, a number for each slot of the directory. Buckets within their capacity
    keep their local depth. One key is never split: what shares it is a chain.
    """
    open_, done = list(range(1 << depth)), []
    while open_:
        counts = {r.cell: r.n for r in keys.groupBy(cell_of("key", depth).alias("cell")).agg(F.count("*").alias("n")).collect()}
        over = [p for p in open_ if counts.get(p, 0) > capacity and depth < 64]
        done += [(p, depth) for p in set(open_) - set(over)]
        open_ = [half for p in over for half in (2 * p, 2 * p + 1)]
        depth += 1
    return Directory(sorted(done, key=lambda b: b[0] << (64 - b[1])))


def _copies(docs: DataFrame, keys: DataFrame, text: str) -> DataFrame:
    """key, n_bytes, text_sha256, and the smallest and largest text (a, b) of those, of texts whose key several rows have.

    Both are found with map-side combining: only texts that have copies move, once for each task. Keys of such texts are
    broadcast if they number BROADCAST_KEYS or fewer; else texts are shuffled by key, and it is Spark's to split a key that
    very many have.
    """
    shared = durable(keys.filter("n > 1").select("key"))
    if shared.count() <= BROADCAST_KEYS:
        shared = F.broadcast(shared)
    bare = docs.select(normalised(F.col(text)).alias("bare"))
    rows = bare.select(key_of(F.col("bare")).alias("key"), "bare").join(shared, "key", "left_semi")
    rows = rows.select("key", F.octet_length("bare").cast("long").alias("n_bytes"), digest_of(F.col("bare")).alias("text_sha256"), "bare")
    return rows.groupBy("key", "n_bytes", "text_sha256").agg(F.min("bare").alias("a"), F.max("bare").alias("b"))


CHAIN = ["key", "n_bytes", "text_sha256"]


@dataclass
class Index:
    """rows: see keyed. directory. path: the bucket files, with a row for each entry of each chain:
    bucket, key, n_bytes, text_sha256, group_size, best (of the row that stays: less, no_id, doc_id, row)."""

    rows: DataFrame
    directory: Directory
    path: str

    def entries(self) -> DataFrame:
        return self.rows.sparkSession.read.parquet(self.path)

    def lookup(self) -> DataFrame:
        """The rows with keep_id, keep_points, group_size, kept: each row's entry in the bucket of its key."""
        entries = self.entries().select("bucket", *CHAIN, "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("keep_points"), F.col("best.row").alias("keep_row"))
        found = self.directory.place(self.rows).join(entries, ["bucket", *CHAIN])
        return found.withColumn("kept", F.col("row") == F.col("keep_row"))


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> Index:
    """The index of all rows of `docs`. Fails if two texts of one digest and length differ in bytes: they cannot be told apart."""
    spark = docs.sparkSession
    rows = durable(keyed(docs, doc_id, text))
    best = F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    entries = durable(rows.groupBy(*CHAIN, "n_points").agg(F.count("*").alias("n"), F.min(best).alias("best")))
    keys = durable(entries.groupBy("key").agg(F.sum("n").alias("n")))
    directory = grown(keys, capacity, (spark.sparkContext.defaultParallelism - 1).bit_length())
    dealt = entries.select(*CHAIN, "n", "best").unionByName(_copies(docs, keys, text), allowMissingColumns=True)
    # One partition for each bucket, kept by the aggregation: an owner sees its whole range of keys.
    owned = directory.place(dealt).repartitionById(len(directory.buckets), F.col("bucket"))
    chains = owned.groupBy("bucket", *CHAIN).agg(F.sum("n").alias("group_size"), F.min("best").alias("best"), F.min("a").alias("a"), F.max("b").alias("b"))
    where = fresh_dir(spark, "hash-index")
    chains.withColumn("same", F.col("a").eqNullSafe(F.col("b"))).drop("a", "b").sortWithinPartitions("bucket", *CHAIN).write.parquet(where)
    index = Index(rows, directory, where)
    if not index.entries().filter("NOT same").isEmpty():
        raise RuntimeError("two texts share key, length and SHA-256 digest but not their bytes")
    return index


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so without spaces, tabs, line feeds, vertical tabs, form feeds and carriage returns;
    null counts as empty, and all empty texts are one group. Exactly one row of a group is kept: that of the most code
    points, then of the smallest doc_id (null last); of rows that repeat both, one. keep_id is null only in groups without
    any doc_id. doc_id may be of any type that can be ordered. Other columns are not read. An empty table gives an empty
    result. Very long texts are values of single rows and stay so.
    """
    return build(docs, doc_id, text, capacity).lookup().select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of `docs` that stay, one of each group of equal texts, in all their columns, whatever these are called.

    Of rows that repeat doc_id, length and text of the one that stays, any one stays, with its own other columns.
    """
    names = [fresh_name(docs, n) for n in ("own_id", "own_points", "own_digest")]
    own = docs.withColumns(dict(zip(names, (F.col(doc_id), F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long"), digest_of(normalised(F.col(text)))), strict=True)))
    marks = [f"{n}_gone" for n in names]
    lost = durable(build(docs, doc_id, text, capacity).lookup().filter("NOT kept").withColumn("tied", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))).select("tied", *[F.col(c).alias(m) for c, m in zip(("doc_id", "n_points", "text_sha256"), marks, strict=True)]).distinct())
    same = F.lit(True)
    for n, m in zip(names, marks, strict=True):
        same = same & F.col(n).eqNullSafe(F.col(m))

    def small(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows

    gone, tied = lost.filter("NOT tied"), lost.filter("tied")
    left = own.join(small(gone), same, "left_anti")
    if not tied.isEmpty():
        tied = small(tied)
        once = left.join(tied, same, "left_semi").dropDuplicates(names)
        left = left.join(tied, same, "left_anti").unionByName(once)
    return left.select(*docs.columns)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents; nulls, ties, repeated rows and the like as in `exact_groups`."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{SPACES}', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, row_number() OVER g = 1 AS kept, h AS text_sha256
FROM d WINDOW g AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST)
"""
