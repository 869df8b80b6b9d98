"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACES, durable, table

#: Fixed by the contract: weights of the sources in code-point order, repeating; share of all sizes; most repeats.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Rows of a source that one prefix-sum window may hold on average. A source has as many windows as it needs.
WINDOW_ROWS = 20_000


def words_in(text: str) -> Column:
    """The number of runs of non-space characters in a text column (null: 0)."""
    bare = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(bare) == 0, 0).otherwise(F.size(F.split(bare, SPACES))).cast("long")


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_rows, target) of each source, null among them, of `sized` (source, size).

    Sources share `share` of all sizes by weight. None gets more than `most` times its size; what is over is shared
    among the rest by weight, until none is above. That is one level: a source is full if its limit over its weight is
    below the level, and sorting by that ratio finds the level without rounds. Rows here are one for each source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    limit = F.col("source_size") * F.lit(float(most))
    order = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(float(share))
    # The level if all earlier sources are full; the first one that then stays within its limit fixes it.
    level = (total - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= limit)
    fixed = F.min(F.when(F.col("open"), F.struct((limit / F.col("weight")).alias("ratio"), "level"))).over(Window.partitionBy(F.lit(0)))
    per = per.withColumn("fixed", fixed["level"])
    return per.select("source", "source_size", "n_rows", F.coalesce(F.least(F.col("fixed") * F.col("weight"), limit), limit).alias("target"))


def mix(docs: DataFrame, keep: tuple = ("doc_id",), seed: str = "mix", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The `keep` columns of `docs` and size, source_size, target, taken: the words of each row that the mix takes.

    `docs` has doc_id, text and source; one row comes back for each of its rows. Each source is put in the order of
    md5(seed:doc_id), so reruns agree, and taken in full as often as its target allows; the last, partial epoch ends at
    the exact word: with the target cut to whole words, the taken words of a source sum to it. Rows of equal doc_id are
    taken in the order of their sizes; which of two equal rows comes first makes no difference. Null doc_ids count as the
    text 'null'. Null sources are one source. Rows without words take none. A new column whose name is one of `keep` gets an
    underscore before it. Only what is kept moves with the rows. An empty table gives an empty result.
    """
    taken = {c.lower() for c in keep}
    names = {n: next(x for x in (n, "_" + n, "__" + n, "___" + n) if x not in taken) for n in ("size", "source_size", "target", "taken")}
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    row = F.struct(*[F.col(c) for c in keep]).alias("row")
    # Only what is kept goes to the shared folder: a few bytes for each text, read three times below.
    sized = durable(docs.select(row, "source", F.col("doc_id").alias("id"), key.alias("rank"), words_in("text").alias("size")))
    per = durable(targets(sized, weights, share, most))
    most_rows = per.agg(F.max("n_rows")).first()[0] or 0
    digits = 2
    while 16**digits * WINDOW_ROWS < most_rows:
        digits += 1
    # A slot is a range of ranks. Prefix sums within a slot start from the sums of the source's slots before it.
    sized = sized.withColumn("slot", F.substring("rank", 1, digits)).withColumn("src", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")))
    ahead = Window.partitionBy("src").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = sized.groupBy("src", "slot").agg(F.sum("size").alias("slot_size"))
    slots = slots.select("src", "slot", F.coalesce(F.sum("slot_size").over(ahead), F.lit(0)).alias("before"))
    per = per.select(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("src"), "source_size", "target")
    inside = Window.partitionBy("src", "slot").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(slots.join(per, "src"), ["src", "slot"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    last = F.least(F.greatest(budget - epochs * F.col("source_size") - F.col("before") - F.col("inside"), F.lit(0)), F.col("size"))
    return rows.withColumn("taken", (epochs * F.col("size") + last).cast("long")).select("row.*", *[F.col(n).alias(own) for n, own in names.items()])


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents; nulls, ties, repeats and the like as in `mix`."""
    return mix(table(spark, sf_dir, "documents"))


#: Everything is plain SQL, as md5 orders the rows alike everywhere.
OP10_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> '')) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS rank FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
o AS (SELECT *, 2.0 * source_size AS cap, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT source, source_size, coalesce(least((SELECT arg_min(level, cap / w) FROM o WHERE level * w <= cap) * w, cap), cap) AS target FROM o),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(floor(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
  CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.rank, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(epochs * size + least(greatest(CAST(floor(target) AS BIGINT) - epochs * source_size - before, 0), size) AS BIGINT) AS taken FROM p
"""
