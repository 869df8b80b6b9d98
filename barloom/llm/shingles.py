"""Near copies by the share of word shingles that two texts have in common.

Texts that SimHash finds (`simhash.py`, operator 9's own method) are linked by it where that is asked for. It cannot find all, so
further candidates are texts that agree in a band of MinHash values; each is verified by the exact Jaccard similarity of the
two sets of shingles. Two texts of similarity s agree in a band with chance 1 - (1 - s**ROWS)**BANDS: 0.9995 at 0.8, more above.
SimHash cannot give all these candidates: at similarity 0.8 fingerprints of 64 bits differ in about ten bits (the angle of sets
with cosine 0.89), and segments that let so many differ are too short to tell texts apart.

What is wanted are the components of all links, so two sets that are known to be in one component need not be compared. All pairs
of a band of at most BUCKET sets are candidates. All sets of a larger band are held against a few heads, those that share most
with others, as the text that others were made of does; then components are found. Sets that share large bands, directly or by
way of others, are a crowd; those not in the crowd's largest component are its strays. Strays and crowd meet in blocks,
each block in one Arrow call that gives out links only, so none is missed between two components, and a large group of copies
makes no pairs. So the components are those of all links between sets that share a band, whatever the bands' sizes.

Candidates are told from the rest within the join, by a sketch of two bits of each MinHash value: pairs with more than
MOST_UNLIKE unlike values, of which texts at 0.8 have 34 on average and more than 55 with chance 0.00003, make no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._common import durable, fresh_name, token_runs, with_arrow_columns
from .components import connected_components, tasks_for

BANDS = 32
ROWS = 7
#: For a least similarity of 0.8: mean and four standard deviations of the unlike two-bit values of BANDS * ROWS.
MOST_UNLIKE = 55
#: A band with more distinct sets than this makes no pairs of its own.
BUCKET = 32
#: Heads of a larger band.
HEADS = 16
#: Sets of either side of a block, which holds 8 bytes for each shingle of each.
BLOCK_SETS = 1_024
#: Up to so many row numbers are broadcast, as one column of longs.
BROADCAST_ROWS = 1_000_000
#: Up to so many heads of bands, of about 150 bytes, are broadcast.
BROADCAST_HEADS = 100_000
#: Sets of hashes that are broadcast have so many bytes at most.
BROADCAST_BYTES = 2 << 20


def hashed_shingles(text: str | None, words: int):
    """Arrays of the XXH64 of a text's shingles, repeats and all, one array for each run of its words.

    A text of fewer words is one shingle; null and wordless texts have none.
    """
    import numpy as np
    import xxhash

    # A-Z to lower case, and every kind of space to one.
    lower = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
    digest = xxhash.xxh64_intdigest

    def shingles(tokens: list[bytes]) -> list[int]:
        joined = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        starts = [0, *ends[:-words].tolist()]
        return [digest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]

    some, held = False, []
    for run in token_runs(text.encode().translate(lower)) if text else ():
        tokens = held + run
        if len(tokens) >= words:
            some = True
            yield np.array(shingles(tokens), dtype="<u8")
        held = tokens[len(tokens) - min(words - 1, len(tokens)) :]
    if not some and held:  # fewer words than a shingle has
        yield np.array([digest(b" ".join(held), 42)], dtype="<u8")


def shingle_set(text: str | None, words: int):
    """The distinct hashes of a text's shingles, sorted."""
    import numpy as np

    parts = list(hashed_shingles(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")


def _signatures(words: int):
    import numpy as np
    import pyarrow as pa
    import xxhash

    rnd = np.random.default_rng(9)
    factor, shift = (rnd.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) for _ in range(2))
    factor |= 1

    def one(text):
        own = shingle_set(text.as_py(), words)
        least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
        high = (own >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(high), 512):
            np.minimum(least, (factor * high[at : at + 512] + shift).min(axis=1), out=least)
        keys = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]
        bits = np.zeros((2, 256), np.uint8)
        bits[:, : len(least)] = least & 1, least >> 1 & 1
        return xxhash.xxh64_intdigest(own.tobytes(), 42), len(own), keys, np.packbits(bits, axis=1).view(np.int64).ravel()

    def work(batch):
        found = [one(text) for text in batch.column("text")]
        keys = np.array([k for f in found for k in f[2]], np.uint64).view(np.int64)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * BANDS, pa.int32()), pa.array(keys))
        sketches = pa.array([f[3] for f in found], pa.list_(pa.int64()))
        return [pa.array(np.array([f[0] for f in found], np.uint64).view(np.int64)), pa.array([f[1] for f in found], pa.int64()), bands, sketches]

    return work


def _printed(words: int):
    """Operator 9's fingerprints before what _signatures gives."""
    prints, signatures = simhash._fingerprints(), _signatures(words)
    return lambda batch: [*prints(batch), *signatures(batch)]


def _sets(words: int):
    import pyarrow as pa

    return lambda batch: [pa.array([shingle_set(text.as_py(), words).tobytes() for text in batch.column("text")], pa.binary())]


def _shared(x, y) -> float:
    """The Jaccard similarity of two sets of hashes, sorted."""
    import numpy as np

    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def _blocks(least: float):
    """For strays and sets of a crowd: links (a, b) between those of different components, a a stray. Told from the rest as in _likely,
    a stray against the block at a time, then verified."""

    def links(strays, crowd):
        import numpy as np
        import pyarrow as pa

        sketches = np.stack(crowd["sketch"].to_numpy()).view(np.uint64) if len(crowd) else None
        roots, sizes, names = (crowd[c].to_numpy() for c in ("root", "n", "s"))
        own = [np.frombuffer(x.as_buffer(), "<u8") for x in crowd["own"]]
        found = []
        for s, root, n, sketch, held in zip(*(strays[c] for c in ("s", "root", "n", "sketch", "own")), strict=True):
            mine, n = np.frombuffer(held.as_buffer(), "<u8"), n.as_py()
            near = (roots != root.as_py()) & (np.minimum(sizes, n) >= least * np.maximum(sizes, n))
            if least >= 0.8:
                apart = sketches ^ np.array(sketch.as_py(), np.int64).view(np.uint64)
                near &= np.bitwise_count(apart[:, :4] | apart[:, 4:]).sum(axis=1) <= MOST_UNLIKE
            found += [(s.as_py(), int(names[i])) for i in np.flatnonzero(near) if _shared(mine, own[i]) >= least]
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return links


def _similarities():
    import numpy as np
    import pyarrow as pa

    def one(a, b) -> float:
        return _shared(*(np.frombuffer(z.as_buffer(), "<u8") for z in (a, b)))

    return lambda batch: [pa.array(map(one, batch.column("own_a"), batch.column("own_b")), pa.float64())]


def some(rows: DataFrame, wanted: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """The join of `rows` with distinct `wanted`, which is broadcast if it has BROADCAST_ROWS rows or fewer: then `rows` stay."""
    wanted = durable(wanted)
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, by, how)


class _Pairs:
    """Verified pairs: `members` has s and the place of a row that has the set, for all sets that need their hashes.

    `once`: whether no two of `rows` (at, text) have one place.
    """

    def __init__(self, rows: DataFrame, once: bool, members: DataFrame, words: int, least: float):
        self.least = least
        wanted = members.select("s", "at").distinct()
        held = with_arrow_columns(some(rows, wanted, "at"), "own binary", lambda: _sets(words), ["s"])
        self.held = durable(held if once else held.dropDuplicates(["s"]))

    def near(self, pairs: DataFrame) -> DataFrame:
        """Those of `pairs` (a, b) whose similarity is `least` or more, each once.

        Many pairs may share few sets b, such as heads. Those sets are broadcast if they have BROADCAST_BYTES or fewer.
        """
        pairs = durable(pairs.distinct())
        if not (n := pairs.count()):
            return pairs
        pairs = pairs.coalesce(tasks := tasks_for(pairs.sparkSession, n))
        own, other = (some(self.held, pairs.select(F.col(x).alias("s")).distinct().coalesce(tasks), "s") for x in "ab")
        if other.agg(F.sum(F.octet_length("own") + 64)).first()[0] <= BROADCAST_BYTES:
            other = F.broadcast(other)
        full = pairs.join(own.toDF("a", "own_a"), "a").join(other.toDF("b", "own_b"), "b")
        near = with_arrow_columns(full, "similarity double", _similarities, ["a", "b"])
        return durable(near.filter(F.col("similarity") >= self.least).drop("similarity"))


def _likely(least: float) -> Column:
    """Whether sets (na, ka) and (nb, kb) may be near: by their sizes and, at 0.8 or more, their sketches."""
    sized = F.least("na", "nb") / F.greatest("na", "nb") >= least
    if least < 0.8:
        return sized

    def unlike(i: int) -> Column:
        return F.col("ka")[i].bitwiseXOR(F.col("kb")[i])

    return sized & (sum((F.bit_count(unlike(i).bitwiseOR(unlike(i + 4))) for i in range(1, 4)), F.bit_count(unlike(0).bitwiseOR(unlike(4)))) <= MOST_UNLIKE)


def _met(a: DataFrame, b: DataFrame, which: Column, least: float) -> DataFrame:
    """(a, b): sets of one band (key, s, n, sketch; and others, as `which` needs them) that may be near, where `which` holds.

    Columns have the suffixes _a and _b in `which`.
    """
    left, right = (x.select(*[F.col(c).alias(f"{c}_{side}") for c in x.columns]) for x, side in ((a, "a"), (b, "b")))
    left, right = left.withColumns({"na": F.col("n_a"), "ka": F.col("sketch_a")}), right.withColumns({"nb": F.col("n_b"), "kb": F.col("sketch_b")})
    return left.join(right, (F.col("key_a") == F.col("key_b")) & which & _likely(least)).select(F.col("s_a").alias("a"), F.col("s_b").alias("b"))


def _links(signed: DataFrame, rows: DataFrame, once: bool, words: int, least: float, bucket: int) -> DataFrame | None:
    """Edges (a, b) whose components are those of all links between sets that share a band; none if there are no such sets. Sets
    without a link have no row. Only bands that two sets have are moved with more than keys."""
    filed = signed.select("s", F.explode("bands").alias("key"))
    shared = filed.groupBy("key").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).filter("lo < hi").select("key")
    found = durable(some(filed, shared, "key").distinct())
    if found.isEmpty():
        return None
    sets = some(signed, found.select("s").distinct(), "s").groupBy("s").agg(F.min("at").alias("at"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    sets = durable(sets)
    sizes = found.groupBy("key").agg(F.count("*").alias("m"))
    banded = durable(found.join(sizes, "key").join(sets.drop("bands"), "s"))
    pairs = _Pairs(rows, once, banded, words, least)
    small = banded.filter(F.col("m") <= bucket).select("key", "s", "n", "sketch")
    edges = pairs.near(_met(small, small, F.col("s_a") < F.col("s_b"), least))
    large = banded.filter(F.col("m") > bucket)
    if large.isEmpty():
        return edges
    # Sets that share many large bands with many others come first among heads.
    central = large.groupBy("s").agg(F.sum("m").alias("central"))
    large = durable(large.select("key", "s", "n", "sketch").join(central, "s").join(sets.select("s", "bands"), "s"))
    part = F.pmod(F.xxhash64("s"), F.lit(HEADS))
    heads = large.groupBy("key", part.alias("part")).agg(F.max(F.struct("central", "s", "n", "sketch", "bands")).alias("h"))
    heads = durable(heads.select("key", "h.*"))
    if heads.limit(BROADCAST_HEADS + 1).count() <= BROADCAST_HEADS:
        heads = F.broadcast(heads)
    # Sets may meet in many bands: the first that they share makes the row.
    first = F.element_at(F.array_intersect("bands_a", "bands_b"), 1) == F.col("key_a")
    edges = durable(edges.unionByName(pairs.near(_met(large, heads, (F.col("s_a") != F.col("s_b")) & first, least))))
    roots = durable(connected_components(edges))
    crowds = connected_components(large.join(large.groupBy("key").agg(F.min("s").alias("b")), "key").select(F.col("s").alias("a"), "b").distinct())
    crowds = crowds.select(F.col("node").alias("s"), F.col("root").alias("crowd")).join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    crowds = durable(crowds)
    main = crowds.groupBy("crowd", "root").agg(F.count("*").alias("m")).groupBy("crowd").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("most"))
    main = main.filter(F.col("all") > F.col("most")).select("crowd", "main", *[F.ceil(x / BLOCK_SETS).cast("long").alias(name) for x, name in ((F.col("all"), "blocks"), (F.col("all") - F.col("most"), "parts"))])
    asked = crowds.join(durable(main), "crowd").join(sets.select("s", "n", "sketch"), "s").join(pairs.held, "s")
    asked = durable(asked)
    edges = roots.filter("node != root").toDF("a", "b")
    if asked.isEmpty():
        return edges
    mine, block = F.pmod(F.xxhash64("s"), F.col("parts")), F.pmod(F.xxhash64("s"), F.col("blocks"))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    strays = asked.filter("root != main").select("crowd", "s", "root", "n", "sketch", "own", mine.alias("part"), every("blocks").alias("block"))
    crowd = asked.select("crowd", "s", "root", "n", "sketch", "own", every("parts").alias("part"), block.alias("block"))
    of = ["crowd", "part", "block"]
    made = durable(strays.groupBy(*of).cogroup(crowd.groupBy(*of)).applyInArrow(_blocks(least), "a long, b long"))
    return edges.unionByName(made)


def _alike(signed: DataFrame) -> DataFrame:
    """Edges (a, b) between sets of texts that operator 9 links: a star for each fingerprint, and its links from centre to centre."""
    sets = durable(signed.select("fp", "s").distinct())
    centres = durable(sets.groupBy("fp").agg(F.min("s").alias("centre")))
    stars = sets.join(centres, "fp").select(F.col("s").alias("a"), F.col("centre").alias("b"))
    linked = simhash.links(centres.select("fp"))
    for end in "ab":
        linked = linked.join(centres.toDF(end, f"centre_{end}"), end)
    return stars.unionByName(linked.select(F.col("centre_a").alias("a"), F.col("centre_b").alias("b"))).filter("a != b")


def drop_near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, bucket: int = BUCKET, fingerprints: bool = False) -> DataFrame:
    """The rows of `docs` (doc_id, text and any others) that stay, in all columns.

    Texts are linked if the sets of their shingles of `words` words have a Jaccard similarity of `least` or more. Words are
    those of simhash.fingerprint, a shorter text is one shingle, and wordless texts are one group. Of each group of rows that
    links between texts with a common band join, directly or by way of others, the one of the smallest doc_id stays (null is
    last). `bucket` changes how groups are found, not which. With `fingerprints`, texts are linked by SimHash too, as operator 9
    has it (`simhash.fingerprint`, 3 or fewer bits), and groups are those of both kinds of links. Long texts are hashed in runs; 8 bytes for each distinct
    shingle are held. Other columns may have any names. An empty table gives an empty result.

    `docs` is read several times, so it should be a table or a checkpoint. Rows are told apart by doc_id and a 64-bit hash of
    the text; of rows that repeat both, all go or any one stays, with its own other columns.
    """
    own, taken = fresh_name(docs, "at"), F.col("at")
    at = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("hash"))
    rows = docs.select(at.alias("at"), "text")
    fields, make = "s long, n long, bands array<long>, sketch array<long>", lambda: _signatures(words)
    if fingerprints:  # in the same worker
        fields, make = f"fp long, {fields}", lambda: _printed(words)
    signed = durable(with_arrow_columns(rows, fields, make, ["at"]))
    repeated = durable(signed.groupBy("at").agg(F.count("*").alias("m")).filter("m > 1").select("at"))
    once = repeated.isEmpty()
    classes = signed.groupBy("s").agg(F.min("at").alias("at")).withColumn("root", F.col("s"))
    edges = _links(signed, rows, once, words, least, bucket)
    if fingerprints:
        edges = _alike(signed) if edges is None else _alike(signed).unionByName(edges)
    if edges is not None:
        roots = connected_components(edges)
        classes = durable(classes.drop("root").join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s")))
    heads = classes.groupBy("root").agg(F.min("at").alias("head"))
    gone = signed.select("s", "at").join(classes.select("s", "root").join(heads, "root"), "s").filter(taken != F.col("head"))
    marked = docs.withColumn(own, at)
    left = some(marked, gone.select(taken.alias(own)).distinct(), own, "left_anti")
    if not once:
        repeated = repeated.withColumnRenamed("at", own)
        left = some(left, repeated, own, "left_anti").unionByName(some(left, repeated, own, "left_semi").dropDuplicates([own]))
    return left.select(*docs.columns)
