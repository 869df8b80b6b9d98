"""Repeated passages by sparse suffix arrays.

Every k-gram of words has a hash; in each window of W k-grams the smallest is a minimiser, so that any SHORTEST words that
two texts share have a minimiser in common, at the same place of the passage. Suffixes are retained there only.

1. One pass over the texts gives (gram, context, doc, place): hashes of the k-gram, and of the LEFT words before and the
   RIGHT words from the place. Grams that fewer than two documents have go.
2. Suffixes with equal contexts are combined: if two documents have one, its words are repeated, and one suffix stays.
3. The suffixes of grams with several contexts are range-sorted by gram and following words (and again by gram and preceding
   words), neighbours of different documents are compared word by word, and matches extended right and left.

A longer passage is found piece by piece, as the next minimiser is within RIGHT words; pieces are joined at the end.
Sorting deals a gram that very many documents have to as many tasks as it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import durable, fresh_dir, slices, table, token_runs
from .decontaminate import NORMAL

SHORTEST = 50
GRAM = 10
W = SHORTEST - GRAM + 1
LEFT, RIGHT = W, SHORTEST + 1


def _hashes(text: str | None):
    """A hash of each word of a text, in order."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    runs = [np.fromiter((digest(w, 7) for w in run), np.uint64, len(run)) for run in token_runs(text.encode().translate(NORMAL))] if text else []
    return np.concatenate(runs) if runs else np.zeros(0, np.uint64)


class _Rolling:
    """Polynomial hashes of any run of words, by prefix sums modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self):
        import numpy as np

        self.np, self.powers, self.inverse = np, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int):
        np = self.np
        if n > len(self.powers):
            n = max(n, 2 * len(self.powers))
            for name, base in (("powers", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def sums(self, hashes):
        self._grow(len(hashes) + 1)
        return self.np.concatenate([self.np.zeros(1, self.np.uint64), self.np.cumsum(hashes * self.powers[: len(hashes)], dtype=self.np.uint64)])

    def of(self, sums, begin, end):
        np = self.np
        x = (sums[end] - sums[begin]) * self.inverse[begin]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _sliding(np, values, width: int, least: bool):
    """The minimum (or maximum) of each `width` neighbours, from running minima of blocks read from both ends."""
    pick, fill = (np.minimum, np.iinfo(np.uint64).max) if least else (np.maximum, 0)
    n = len(values)
    padded = np.full(-(-n // width) * width, fill, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: n - width + 1], ahead[width - 1 : n])


def minimisers(grams, width: int = W):
    """Places of grams that are smallest in some window of `width`; all of equal ones."""
    import numpy as np

    if len(grams) < width:
        return np.flatnonzero(grams == grams.min()) if len(grams) else np.zeros(0, np.int64)
    least = _sliding(np, grams, width, True)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero(_sliding(np, padded, width, False) == grams)


def _anchors(docs: DataFrame) -> DataFrame:
    """(gram, context, doc_id, place, before, after) of every minimiser of every text of SHORTEST words or more."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rolling = _Rolling()
        for batch in batches:
            for part in slices(batch):
                columns: list[list] = [[], [], [], [], []]
                rows = []
                for row, text in enumerate(part.column("text")):
                    hashes = _hashes(text.as_py())
                    n = len(hashes)
                    if n < SHORTEST:
                        continue
                    sums = rolling.sums(hashes)
                    starts = np.arange(n - GRAM + 1)
                    grams = rolling.of(sums, starts, starts + GRAM)
                    at = minimisers(grams)
                    begin, end = np.maximum(at - LEFT, 0), np.minimum(at + RIGHT, n)
                    context = rolling.of(sums, begin, end) ^ ((at - begin) * 1000 + (end - at)).astype(np.uint64)
                    for column, values in zip(columns, (grams[at].view(np.int64), context.view(np.int64), at, at - begin, end - at), strict=True):
                        column.append(values)
                    rows.append(np.full(len(at), row))
                if rows:
                    gram, context, place, before, after = (np.concatenate(c) for c in columns)
                    names = ["gram", "context", "doc_id", "place", "before", "after"]
                    arrays = [pa.array(gram), pa.array(context), part.column("doc_id").take(pa.array(np.concatenate(rows))), pa.array(place, pa.int32()), pa.array(before, pa.int32()), pa.array(after, pa.int32())]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "gram long, context long, doc_id long, place int, before int, after int")


def _suffixes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, following, preceding, doc_id, place): words around the wanted places, 4 bytes of hash for each word."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "place")).alias("places"))  # of one document, at most its words
    joined = docs.select("doc_id", "text").join(lists, "doc_id")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, text, places in zip(part.column("doc_id"), part.column("text"), part.column("places"), strict=True):
                    short = _hashes(text.as_py()).astype(np.uint32)
                    for place in places.as_py():
                        at = place["place"]
                        # A repeated doc_id may have come with another text: only places in this one count.
                        if at + GRAM <= len(short):
                            rows.append((place["gram"], short[at : at + RIGHT].tobytes(), short[max(at - LEFT, 0) : at][::-1].tobytes(), doc.as_py(), at))
                if rows:
                    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["gram", "following", "preceding", "doc_id", "place"])

    return joined.mapInArrow(run, "gram long, following binary, preceding binary, doc_id long, place int")


def shared_words(a: bytes, b: bytes) -> int:
    """Of two runs of 4-byte words, how many they begin with in common."""
    n = min(len(a), len(b)) // 4 * 4
    if a[:n] == b[:n]:
        return n // 4
    low, high = 0, n // 4 - 1  # words known to be equal; the most that may be
    while low < high:
        mid = (low + high + 1) // 2
        if a[4 * low : 4 * mid] == b[4 * low : 4 * mid]:
            low = mid
        else:
            high = mid - 1
    return low


def shared(a: tuple, b: tuple) -> tuple[int, int]:
    """Words that suffixes (gram, following, preceding, doc_id, place) share from their places on, and before them."""
    after = shared_words(a[1], b[1])
    return (after, shared_words(a[2], b[2])) if after >= GRAM else (0, 0)


SUFFIX = ("gram", "following", "preceding", "doc_id", "place")
FOUND = "gram long, doc_id long, place int, most int, sure boolean, begin long, end long, other long"


class _Run:
    """Neighbouring suffixes of one gram and document, with the most that each shares with another document's neighbour."""

    def __init__(self, follows: bool):
        self.follows, self.rows, self.most, self.sure = follows, [], [], []

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.most.append(0)
        self.sure.append(False)

    def meet(self, i: int, after: int, before: int) -> None:
        most, sure = after if self.follows else before, after + before >= SHORTEST
        if most > self.most[i]:
            self.most[i], self.sure[i] = most, sure
        elif most == self.most[i]:
            self.sure[i] |= sure


def _neighbours(suffixes: DataFrame, by: str) -> DataFrame:
    """What comparing neighbours in the order of gram and `by` gives, of a written table of suffixes.

    Rows with `begin` are spans that two documents share. The others tell of each suffix the most words that it shares, on the
    side of `by`, with any other document, and whether with that one it shares SHORTEST in all (`sure`). Rows are range-sorted;
    each is compared with the last one before it and the first one after it that another document has. At the ends of a task's
    range one of these is missing: there `most` is all that a suffix has, and nothing is sure.
    """
    follows = by == "following"
    limit = RIGHT if follows else LEFT

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int32()), ("most", pa.int32()), ("sure", pa.bool_()), ("begin", pa.int64()), ("end", pa.int64()), ("other", pa.int64())])
        out: list[tuple] = []

        def match(a, b):
            after, before = shared(a, b)
            if after + before >= SHORTEST:
                for x, y in ((a, b), (b, a)):
                    out.append((None, x[3], None, None, None, x[4] - before, x[4] + after, y[3]))
            return after, before

        def close(done: _Run, edge: bool):
            for row, most, sure in zip(done.rows, done.most, done.sure, strict=True):
                out.append((row[0], row[3], row[4], limit if edge else most, sure and not edge, None, None, None))

        def give():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return batch

        now, other, first = None, None, True
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in SUFFIX], strict=True):
                last = now.rows[-1] if now else None
                if last is None or last[0] != row[0] or last[3] != row[3]:
                    then, now = now, _Run(follows)
                    now.add(row)
                    other = None
                    if then:
                        if last[0] == row[0]:
                            other = last
                            for i, before in enumerate(then.rows):
                                met = match(before, row)
                                then.meet(i, *met)
                                now.meet(0, *met)
                        close(then, first)
                        first = False
                else:
                    now.add(row)
                    if other is not None:
                        now.meet(len(now.rows) - 1, *match(other, row))
                if len(out) > 20_000:
                    yield give()
        if now:
            close(now, True)
        if out:
            yield give()

    order = ["gram", by, "doc_id", "place"]
    return durable(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, FOUND))


def _windows(suffixes: DataFrame) -> DataFrame:
    """(window, doc_id, begin): a hash of every run of SHORTEST words that holds a suffix's place and lies within `before` words
    ahead of it and `after` words from it on."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rolling = _Rolling()
        for batch in batches:
            hashes, docs, begins = [], [], []
            for following, preceding, doc, place, after, before in zip(*[batch.column(c).to_pylist() for c in ("following", "preceding", "doc_id", "place", "after", "before")], strict=True):
                ahead, behind = np.frombuffer(following, np.uint32)[:after], np.frombuffer(preceding, np.uint32)[:before]
                words = np.concatenate([behind[::-1], ahead]).astype(np.uint64) + np.uint64(1)
                starts = np.arange(len(words) - SHORTEST + 1)
                if len(starts):
                    hashes.append(rolling.of(rolling.sums(words), starts, starts + SHORTEST).view(np.int64))
                    docs += [doc] * len(starts)
                    begins.append(place - len(behind) + starts)
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(docs, pa.int64()), pa.array(np.concatenate(begins), pa.int64())], names=["window", "doc_id", "begin"])

    return suffixes.select("following", "preceding", "doc_id", "place", "after", "before").mapInArrow(run, "window long, doc_id long, begin long")


def _hidden(suffixes: DataFrame, follow: DataFrame, precede: DataFrame) -> DataFrame:
    """Spans that neighbours may hide: where the partner that shares most on one side shares too little in all.

    A suffix that could share SHORTEST words, by the most on either side, but is not sure of both has its gram looked at again: all
    its suffixes that could, give the hashes of their runs of SHORTEST words, and equal ones of different documents are spans.
    """
    key = ["gram", "doc_id", "place"]
    sides = [f.filter("begin IS NULL").groupBy(*key).agg(F.max("most").alias(name), F.min("sure").alias(f"sure_{name}")) for f, name in ((follow, "after"), (precede, "before"))]
    could = durable(sides[0].join(sides[1], key).filter(F.col("after") + F.col("before") >= SHORTEST))
    grams = durable(could.filter("NOT (sure_after AND sure_before)").select("gram").distinct())
    again = suffixes.join(could.join(grams, "gram").select(*key, "after", "before"), key)
    runs = durable(_windows(again).distinct())
    pairs = runs.groupBy("window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    found = runs.join(durable(pairs), "window")
    return found.select("doc_id", "begin", (F.col("begin") + SHORTEST).alias("end"), F.when(F.col("doc_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("other"))


def joined(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of each document as one: doc_id, first_word, n_words, other_doc_id (the smallest)."""
    order = Window.partitionBy("doc_id").orderBy("begin", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(reach.isNull() | (F.col("begin") > reach), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = marked.groupBy("doc_id", "island").agg(F.min("begin").alias("first_word"), F.max("end").alias("last"), F.min("other").alias("other_doc_id"))
    return found.select("doc_id", "first_word", (F.col("last") - F.col("first_word")).alias("n_words"), "other_doc_id")


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, first_word, n_words, other_doc_id: the runs of SHORTEST words or more of a text that another one has too.

    Words are runs of letters, digits and non-ASCII bytes, A-Z in lower case, counted from 0. Runs that overlap or touch
    are one row; other_doc_id is the smallest document that was matched in it. Repeats within one document do not count,
    nor do those between rows of one doc_id. Null and short texts have no row, and rows without doc_id are left out, as
    nothing could name them.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")
    where = fresh_dir(spark, "anchors")
    _anchors(named).write.parquet(where)
    anchors = spark.read.parquet(where)
    # Counting is combined on the map side. The join's skew, a gram of very many documents, is Spark's to split.
    # For that its other side must be a table, not an aggregation dealt out by the same key.
    common = durable(anchors.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("gram"))
    shared_ = durable(anchors.join(common, "gram"))
    classes = durable(
        shared_.groupBy("gram", "context").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(F.struct("doc_id", "place")).alias("first"), F.max(F.struct("doc_id", "place")).alias("last"))
    )
    whole = classes.filter("lo < hi").select("gram", "context", "lo", "hi")
    equal = shared_.filter(F.col("before") + F.col("after") >= SHORTEST).join(whole, ["gram", "context"])
    spans = equal.select("doc_id", (F.col("place") - F.col("before")).cast("long").alias("begin"), (F.col("place") + F.col("after")).cast("long").alias("end"), F.when(F.col("doc_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("other"))
    mixed = durable(classes.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"))
    # Of a context that several documents have, the suffixes of two stand for all; one document's own are all compared.
    alone = shared_.join(classes.filter("lo = hi").select("gram", "context"), ["gram", "context"]).select("gram", "doc_id", "place")
    several = classes.filter("lo < hi").select("gram", F.explode(F.array("first", "last")).alias("s")).select("gram", "s.*")
    wanted = several.unionByName(alone).join(mixed, "gram")
    held = fresh_dir(spark, "suffixes")
    _suffixes(named, wanted).write.parquet(held)
    suffixes = spark.read.parquet(held)
    follow, precede = _neighbours(suffixes, "following"), _neighbours(suffixes, "preceding")
    for found in (follow, precede):
        spans = spans.unionByName(found.filter("begin IS NOT NULL").select("doc_id", "begin", "end", "other"))
    return joined(spans.unionByName(_hidden(suffixes, follow, precede)))


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Passages of all documents that repeat, by document; doc_ids are whole numbers, null texts have no words, repeated rows are copies of
    each other. An empty table gives an empty result."""
    return repeated_passages(table(spark, sf_dir, "documents"))
