"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32. Fingerprints that differ in at most three bits differ in at
most one bit of one of the segments, so each fingerprint is filed under both segments, and looked up under both and
under each segment with one set bit cleared (of two segments that differ in one bit, one has it set). Matches are
verified by their whole distance. A lookup makes at most BUCKET matches; segments under which more distinct
fingerprints are filed are linked through shared Hamming-ball centres instead, which takes no pairs at all.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import durable, fresh_name, table, token_runs, with_arrow_columns
from .components import connected_components

#: A segment with more distinct fingerprints than this is linked through ball centres.
BUCKET = 64
LOW32 = 0xFFFFFFFF


def _fingerprints(words: int = 3):
    import numpy as np
    import pyarrow as pa
    import xxhash

    # A-Z to lower case, and every kind of space to one.
    lower = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
    digest = xxhash.xxh64_intdigest

    def shingles(tokens: list[bytes]) -> list[int]:
        joined = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        starts = [0, *ends[:-words].tolist()]
        return [digest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]

    def one(text) -> int:
        data = text.as_py()
        counts, n, held = np.zeros(64, np.int64), 0, []
        for run in token_runs(data.encode().translate(lower)) if data else ():
            tokens = held + run
            if len(tokens) >= words:
                hashes = np.array(shingles(tokens), dtype="<u8")
                n += len(hashes)
                for at in range(0, len(hashes), 65536):
                    counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            held = tokens[len(tokens) - min(words - 1, len(tokens)) :]
        if not n and held:  # fewer words than a shingle has
            n, hashes = 1, np.array([digest(b" ".join(held), 42)], dtype="<u8")
            counts += np.unpackbits(hashes.view(np.uint8), bitorder="little")
        return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])

    def work(batch):
        found = np.fromiter(map(one, batch.column("text")), np.uint64, batch.num_rows)
        return [pa.array(found.view(np.int64))]

    return work


def fingerprint(docs: DataFrame, text: str = "text", words: int = 3, keep: list[str] | None = None) -> DataFrame:
    """`docs` with `fp`, its SimHash as a signed long.

    Words are runs of what is neither a space nor a tab, line feed, vertical tab, form feed or carriage return, with
    A-Z in lower case; shingles of `words` of them are hashed with repeats. A shorter text is one shingle. Null and
    wordless texts get 0. A column named `fp` is replaced.
    """
    if text != "text":
        docs = docs.drop("text").withColumnRenamed(text, "text")
    kept = docs.columns if keep is None else keep
    return with_arrow_columns(docs.select(*{*kept, "text"}), "fp long", lambda: _fingerprints(words), kept)


def _segments(fps: DataFrame) -> DataFrame:
    """fp, seg, key (the segment's 32 bits), used (bits changed to get there: 0 or 1), rest (the other 32 bits)."""
    low, high = F.col("fp").bitwiseAND(F.lit(LOW32)), F.shiftrightunsigned("fp", 32)
    bits = F.array(*[F.lit(1 << i) for i in range(32)])

    def filed(seg: int, key: Column, rest: Column) -> Column:
        def entry(k: Column, used: int) -> Column:
            return F.struct(F.lit(seg).alias("seg"), k.alias("key"), F.lit(used).alias("used"), rest.alias("rest"))

        set_bits = F.filter(bits, lambda bit: key.bitwiseAND(bit) != 0)
        return F.concat(F.array(entry(key, 0)), F.transform(set_bits, lambda bit: entry(key - bit, 1)))

    rows = [filed(0, low, high), filed(1, high, low)]
    return fps.select("fp", F.inline(F.concat(*rows)))


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links at 3 or fewer bits.

    `fps` has distinct fingerprints, column `fp`. Every edge joins fingerprints that are linked, or a fingerprint and a
    fellow of a ball centre through which both are linked.
    """
    rows = _segments(fps)
    filed = rows.filter("used = 0").select("seg", "key", F.col("fp").alias("a"))
    large = durable(filed.groupBy("seg", "key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).select("seg", "key"))
    some = not large.isEmpty()
    if some:
        filed = filed.join(large, ["seg", "key"], "left_anti")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= 3
    once = (F.col("used") == 1) | (F.col("a") < F.col("fp"))
    found = filed.join(rows, ["seg", "key"]).filter(near & once & (F.col("a") != F.col("fp"))).select("a", F.col("fp").alias("b"))
    return found.unionByName(_hubs(rows.join(large, ["seg", "key"], "left_semi"))) if some else found


def _hubs(rows: DataFrame) -> DataFrame:
    """Edges through ball centres, for rows of large segments.

    A row that has used u bits goes to all centres within 2 - u bits of its rest; it is `close` to those within 1 - u.
    Two rows with one centre, of which one is close, are at most three bits apart, and each pair so near has such a
    centre. So all rows of a centre that has a close one are linked to the smallest close one: a row each, no pairs.
    """
    masks = [sum(1 << i for i in bits) for n in range(3) for bits in combinations(range(32), n)]
    balls = F.filter(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.struct(F.col("rest").bitwiseXOR(m).alias("centre"), (F.bit_count(m) + F.col("used")).alias("far"))), lambda x: x["far"] <= 2)
    at = rows.select("seg", "key", "fp", F.inline(balls))
    heads = at.filter("far <= 1").groupBy("seg", "key", "centre").agg(F.min("fp").alias("a"))
    return at.join(heads, ["seg", "key", "centre"]).filter(F.col("a") != F.col("fp")).select("a", F.col("fp").alias("b")).distinct()


def fingerprint_components(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(fp, component_id) for distinct fingerprints (fp, least): the smallest `least` of all that links of 3 or fewer bits reach."""
    roots = connected_components(links(fps.select("fp"), bucket))
    # Only fingerprints with a link have a root: a broadcast or a join of small rows, that skew handling may split.
    classes = durable(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    named_roots = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return classes.join(named_roots, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest doc_id among all rows that can be reached through links of 3 or fewer bits. Null
    doc_ids keep their rows and are never a component_id, unless a component has no other. Rows that share a doc_id stay
    apart. An empty table gives an empty result.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    printed = durable(fingerprint(named, keep=["doc_id"]))
    named = fingerprint_components(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), bucket)
    return (
        printed.join(named, "fp")
        .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    )


def drop_near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The rows of `docs` (doc_id, text and any others) that stay, in all columns: of each component the smallest doc_id.

    Rows are named by doc_id: those that share one go if one of them does, and rows without one stay.
    """
    mark = fresh_name(docs, "gone")
    gone = near_duplicates(docs, bucket=bucket).filter("doc_id != component_id").select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(durable(gone), F.col("doc_id") == F.col(mark), "left_anti")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; nulls, repeats and the like as in `near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "documents"))
