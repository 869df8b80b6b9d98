"""How five quality filters interact, in every order of applying them.

Each document gets a mask of the filters it fails. Four of them look at the document alone; the fifth, whether an earlier
document has the same text, is decided by fingerprints: texts are routed by their XXH64 to owner partitions, which store
chains of texts that share a fingerprint, each in full and with the smallest doc_id seen, and give out the ids that are not
the smallest. A task chains its own rows before anything is routed, so a text goes to its owner once for each task that has
it, however many copies there are; ids that lose on the way are spread over all partitions.

Rows of a mask are counted by part in vectors that are merged by key. All that 120 orders report follows from these counts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable, table, token_runs, with_arrow_columns

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
DUPLICATE = 1 << FILTERS.index("E")
#: Fixed by the contract: what filters A to D ask for.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, b"#$%&*|"
#: Bytes of texts that a partition of chains holds on average, and that a task holds before it routes what it has.
CHAIN_BYTES = 32 << 20
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _looks():
    import pyarrow as pa
    import xxhash

    capitals, others = bytes(range(65, 91)), bytes(c for c in range(256) if c not in SYMBOLS)
    spaces = bytes(32 if 9 <= c <= 13 else c for c in range(256))

    def one(text: str) -> tuple[int, int, int]:
        data = text.encode()
        words, distinct = 0, set()
        for run in token_runs(data.translate(spaces)):
            words += len(run)
            distinct.update(run)
        upper = len(data) - len(data.translate(None, capitals))
        fails = words < LEAST_WORDS, 100 * len(distinct) < LEAST_DISTINCT * words, 100 * upper > MOST_CAPITALS * len(text), bool(data.translate(None, others))
        key = xxhash.xxh64_intdigest(data)
        return sum(f << i for i, f in enumerate(fails)), key - (key >> 63 << 64), len(data)

    def work(batch):
        found = [one(text.as_py() or "") for text in batch.column("text")]
        return [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]

    return work


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part (lang; null: empty), mask (bits of filters A to D that fail), key (the text's XXH64), n_bytes; a row for each of `docs`.

    Null texts are empty. Long texts are counted in runs of their words; the distinct words of one text are held.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    return with_arrow_columns(rows, "mask int, key long, n_bytes long", _looks, ["doc_id", "part"])


def _chain(chains: dict, key: int, text: str, doc_id):
    """Files the text in its key's chain; the id that is now known not to be the smallest, if any."""
    chain = chains.setdefault(key, [])
    for entry in chain:
        if entry[0] == text:
            low, high = (entry[1], doc_id) if entry[1] <= doc_id else (doc_id, entry[1])
            entry[1] = low
            return None if low == high else high
    chain.append([text, doc_id])
    return None


def _routed(rows):
    """(key, (text, smallest id)) of a task's own chains, and (some number, (None, (id, key))) of ids that have lost in them."""
    import xxhash

    chains, held = {}, 0

    def told():
        for key, chain in chains.items():
            for text, doc_id in chain:
                yield key, (text, doc_id)

    for n, row in enumerate(rows):
        if row.doc_id is None:  # neither earlier nor later than any
            continue
        text = row.text or ""
        key = xxhash.xxh64_intdigest(text)
        new = key not in chains
        lost = _chain(chains, key, text, row.doc_id)
        if lost is not None:
            yield n, (None, (lost, key))
        held += (len(text) + 200) * new
        if held > CHAIN_BYTES:
            yield from told()
            chains, held = {}, 0
    yield from told()


def _owned(rows):
    """The (id, key) pairs that are not the smallest of their text, of all rows that were routed to an owner."""
    chains: dict = {}
    for key, (text, found) in rows:
        if text is None:
            lost = found
        else:
            high = _chain(chains, key, text, found)
            lost = None if high is None else (high, key)
        if lost is not None:
            yield lost[0], lost[1] - (lost[1] >> 63 << 64)


def later_copies(docs: DataFrame, partitions: int) -> DataFrame:
    """Distinct (doc_id, key) of rows whose text some smaller doc_id has too, in all of `docs` (doc_id, text).

    Null texts are empty, null doc_ids take no part, and rows that repeat doc_id and text are one. Any ordered type of
    doc_id will do. Texts that share a fingerprint are told apart by their characters. An owner holds the distinct texts of
    its keys: `partitions` should leave each some CHAIN_BYTES.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    spark = docs.sparkSession
    lost = docs.select("doc_id", "text").rdd.mapPartitions(_routed).partitionBy(partitions, lambda key: key % partitions).mapPartitions(_owned)
    schema = StructType([docs.schema["doc_id"], StructField("key", LongType())])
    schema["doc_id"].nullable = True
    return spark.createDataFrame(lost, schema, verifySchema=False).distinct()


def _vector(fact):
    return _add([0] * (3 * MASKS), fact)


def _add(vector, fact):
    mask, good, toxic = fact
    vector[mask] += 1
    vector[MASKS + mask] += good
    vector[2 * MASKS + mask] += toxic
    return vector


def _merge(a, b):
    return [x + y for x, y in zip(a, b, strict=True)]


def report(part: str, vector: list[int]):
    """Rows of SCHEMA for a part, from counts of all, good and toxic documents by mask."""
    rows, every = [], range(MASKS)
    shapley = dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            here = [m for m in every if m & bit and not m & before]
            removed, good, toxic = (sum(vector[at * MASKS + m] for m in here) for at in range(3))
            redundant = sum(vector[m] for m in every if m & bit and m & before)
            kept = sum(vector[m] for m in every if not m & (before | bit))
            rows.append(("".join(order), step, name, kept, removed, redundant, vector[bit], good, toxic))
            shapley[name] += removed
            before |= bit
    return [(part, order, step, *counts, shapley[name]) for order, step, name, *counts in rows]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: documents kept, removed, redundant, failing nothing else, good and toxic ones
    lost, and the filter's removals summed over all orders.

    `docs` has doc_id, text and lang, `labels` doc_id, quality and toxic; other columns do not matter. A document is good or
    toxic if any of its labels is 1. Each row counts, repeated ones too: of rows with one doc_id and one text none is the
    later copy of the other. Null texts and languages are empty; null doc_ids have no labels and are never later copies.
    An empty table gives no rows. Only distinct texts of a task are moved, once; all else moved is numbers.
    """
    spark = docs.sparkSession
    looked = durable(masks(docs))
    n_bytes = looked.agg(F.sum("n_bytes")).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // CHAIN_BYTES))
    copies = later_copies(docs, partitions).withColumn("bit", F.lit(DUPLICATE))
    marks = labels.groupBy("doc_id").agg(*[F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "bad"))])
    facts = looked.join(copies, ["doc_id", "key"], "left").join(marks, "doc_id", "left")
    facts = facts.select("part", F.col("mask").bitwiseOR(F.coalesce("bit", F.lit(0))).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))
    vectors = facts.rdd.map(lambda r: (r.part, (r.mask, r.good, r.bad))).combineByKey(_vector, _add, _merge)
    return spark.createDataFrame(vectors.flatMap(lambda kv: report(*kv)), SCHEMA)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents; nulls, repeats and the like as in `audit`."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS name, CAST(1 << (ascii(filter_order[step]) - 65) AS INT) AS bit, CAST(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS INT) AS before
  FROM (SELECT filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM o)),
r AS (SELECT part, filter_order, step, name, CAST(sum(CASE WHEN mask & (coalesce(before, 0) | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0) = 0 THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, name)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, name) AS BIGINT) AS shapley FROM r
"""
