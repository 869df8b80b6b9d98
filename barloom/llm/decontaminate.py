"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, one scan of every text.

Normalising maps bytes to bytes of the same place (A-Z to a-z, separators to spaces), so a word's place in the
normalised text is its place in the original; joined words are scanned, and hits are mapped back through word numbers.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD_SEPARATORS, durable, fresh_name, table, token_runs, with_arrow_columns

#: Characters of distinct windows that one automaton holds; it needs some 50 bytes for each. Of a benchmark with more, each
#: block of windows is an automaton, and each scans all documents: one that does not fit a worker could not be sent to it.
BLOCK_CHARS = 4_000_000

#: Fixed: what the contract calls a word keeps digits, letters and every byte from 0x80 on.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_built: dict = {}


def normal_words(text: str | None) -> list[bytes]:
    return text.encode().translate(NORMAL).split() if text else []


def windows_of(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The distinct windows of all items as (pattern, owners), and (owners, owner): who they are.

    A pattern is words between spaces, as Latin-1. Windows of the same items share a set of owners, which is named by how many
    they are and 128 bits of their ids' hashes; null if no owner has an id. No list of owners is made, however many a window has.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for item, text in zip(batch.column("item_id"), batch.column("text"), strict=True):
                words = normal_words(text.as_py())
                found = {b" ".join(words[at : at + window]).decode("latin-1") for at in range(max(1, len(words) - window + 1) if words else 0)}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([item.as_py()] * len(found), pa.string())], names=["pattern", "owner"])

    pairs = durable(items.mapInArrow(run, "pattern string, owner string").distinct())
    halves = [F.lpad(F.hex(F.bit_xor(F.xxhash64(F.lit(i), "owner"))), 16, "0") for i in (1, 2)]
    named = F.when(F.count("owner") > 0, F.concat_ws("-", F.count("owner"), *halves))
    # A null owner hashes like its seed: it is left out, not mixed in.
    known = pairs.filter("owner IS NOT NULL").groupBy("pattern").agg(named.alias("owners"))
    patterns = durable(pairs.select("pattern").distinct().join(known, "pattern", "left"))
    first = patterns.filter("owners IS NOT NULL").groupBy("owners").agg(F.min("pattern").alias("pattern"))
    return patterns, pairs.filter("owner IS NOT NULL").join(first, "pattern").select("owners", "owner")


def _automaton(token: str, windows: list):
    """Patterns are windows between spaces; a value is (words of the pattern, name of the set of items that have it)."""
    if token not in _built:
        import ahocorasick

        found = ahocorasick.Automaton()
        for pattern, owners in windows:
            found.add_word(f" {pattern} ", (pattern.count(" ") + 1, owners))
        if windows:
            found.make_automaton()
        _built.clear()
        _built[token] = found if windows else None
    return _built[token]


def _runs(marks: bytearray) -> list[tuple[int, int]]:
    runs, at = [], marks.find(1)
    while at >= 0:
        end = marks.find(0, at)
        end = len(marks) if end < 0 else end
        runs.append((at, end))
        at = marks.find(1, end)
    return runs


def _scan(token: str, block, window: int):
    import re

    import pyarrow as pa

    automaton = _automaton(token, block.value)
    word = re.compile(rb"[^ ]+")

    def hits(data: bytes):
        """The number of words, their marks (None if no window occurs) and the sets of items that have them.

        Runs of words are scanned with the last words of the run before them, so no window is cut.
        """
        marks, who, total, held = None, set(), 0, []
        for run in token_runs(data):
            tokens = held + run
            first, total = total - len(held), total + len(run)
            if automaton is not None:
                line, seen, at = f" {b' '.join(tokens).decode('latin-1')} ", 0, 0
                for end, (n, owners) in automaton.iter(line):
                    seen += line.count(" ", at, end)
                    at = end
                    marks = bytearray() if marks is None else marks
                    if len(marks) < total:
                        marks.extend(bytes(total - len(marks)))
                    marks[first + seen - n : first + seen] = b"\x01" * n
                    who.add(owners)
            held = tokens[len(tokens) - min(window - 1, len(tokens)) :]
        return total, marks, who

    def one(text):
        raw = text.encode() if text else b""
        plain = raw.translate(NORMAL)
        total, marks, who = hits(plain)
        if marks is None:
            return total, [], []
        spans, chars, byte, runs = [], 0, 0, iter(_runs(marks))
        wanted, begin = next(runs), None
        for i, m in enumerate(word.finditer(plain)):  # to the last hit word
            if i == wanted[0]:
                chars += len(raw[byte : m.start()].decode())
                byte, begin = m.start(), chars
            if i == wanted[1] - 1:
                chars += len(raw[byte : m.end()].decode())
                byte = m.end()
                spans.append({"first_word": wanted[0], "n_words": wanted[1] - wanted[0], "begin": begin, "end": chars})
                wanted = next(runs, None)
                if wanted is None:
                    break
        return total, spans, who

    span = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())]))

    def work(batch):
        rows = [one(x.as_py()) for x in batch.column("text")]
        return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], span), pa.array([sorted(x for x in r[2] if x) for r in rows], pa.list_(pa.string()))]

    return work


FOUND = ("n_words", "spans", "items")


def _with_items(found: DataFrame, owners: DataFrame, sets: str, items: str) -> DataFrame:
    """`found` with `items`, the sorted ids of all owners of its `sets`: looked up once for all rows that have the same sets."""
    found = durable(found)
    hit = F.size(sets) > 0
    each = found.filter(hit).select(sets).distinct().withColumn("owners", F.explode(sets))
    lists = each.join(owners, "owners").groupBy(sets).agg(F.array_sort(F.collect_set("owner")).alias(items))
    none = F.array().cast("array<string>")
    return found.filter(hit).join(lists, sets).unionByName(found.filter(~hit).withColumn(items, none)).drop(sets)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: list[str] | None = None, block_chars: int = BLOCK_CHARS, names: tuple[str, ...] = FOUND) -> DataFrame:
    """`docs` (with `text`) and n_words, spans, items: what of each text stands in an item's window of `window` words.

    A shorter item is one window; a wordless or null one has none. spans lists the maximal runs of hit words (first_word,
    n_words; begin and end in the original text's characters); items lists the ids, as distinct sorted strings, of the
    items with an occurring window. Items without an id mark words but are not listed. Null texts have no words. Rows are
    scanned each by itself, long ones in runs; an empty table gives an empty result. `names` are the new columns' names;
    columns of `docs` with these are replaced. Without a third name, items are not looked up and rows are not written. The
    items' distinct windows are counted first: those that one automaton of `block_chars` can hold are scanned at once, more of
    them in blocks by a hash of the window. Who owns them stays in a table, in which the sets of items that texts hit are looked up.
    """
    spark = docs.sparkSession
    patterns, owners = windows_of(benchmark, window)
    size = patterns.agg(F.sum(F.char_length("pattern") + 2)).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {n.lower() for n in names}]
    sets = "owner_sets"
    while sets in {c.lower() for c in (*kept, *names)}:
        sets = f"_{sets}"
    columns = (*names[:2], sets)
    fields = f"`{names[0]}` long, `{names[1]}` array<struct<first_word:long,n_words:long,begin:long,end:long>>, `{sets}` array<string>"

    def finish(found: DataFrame) -> DataFrame:
        return _with_items(found, owners, sets, names[2]).select(*kept, *names) if len(names) > 2 else found.select(*kept, *names)

    def parts(source: DataFrame, carried: list[str]):
        for i in range(blocks):
            mine = patterns.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == i) if blocks > 1 else patterns
            # `block_chars` bounds what is collected and broadcast: of a window's owners there is one short name.
            block = spark.sparkContext.broadcast([tuple(r) for r in mine.select("pattern", "owners").collect()])
            yield with_arrow_columns(source, fields, lambda token=uuid.uuid4().hex, block=block: _scan(token, block, window), carried)

    if blocks == 1:
        return finish(next(parts(docs.select(*{*kept, "text"}), kept)))
    number = fresh_name(docs, "scan_row")  # the same row's finds are brought together by a number that must not change between scans
    docs = durable(docs.select(*{*kept, "text"}).withColumn(number, F.monotonically_increasing_id()))
    united = None
    for part in parts(docs.select(number, "text"), [number]):
        united = part if united is None else united.unionByName(part)
    united = durable(united.toDF(number, *FOUND))
    # Few rows have finds; a row's finds number at most its own words.
    found = united.groupBy(number).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("raw"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = F.aggregate(
        "raw",
        F.filter(F.col("raw"), lambda x: F.lit(False)),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["first_word"] + F.element_at(acc, -1)["n_words"] >= x["first_word"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
                F.element_at(acc, -1)["first_word"].alias("first_word"),
                (F.greatest(F.element_at(acc, -1)["first_word"] + F.element_at(acc, -1)["n_words"], x["first_word"] + x["n_words"]) - F.element_at(acc, -1)["first_word"]).alias("n_words"),
                F.element_at(acc, -1)["begin"].alias("begin"),
                F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"),
            ))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    found = found.select(number, "n_words", F.when(F.size("raw") > 0, merged).otherwise(F.col("raw")).alias("spans"), "items")
    return finish(docs.select(*kept, number).join(found.toDF(number, *columns), number).drop(number))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of `docs`, in all their columns, in which no word is part of an item's window."""
    names = tuple(fresh_name(docs, n) for n in FOUND[:2])
    return scan(docs, benchmark, window, names=names).filter(F.size(names[1]) == 0).select(*docs.columns)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Hits of every document against the whole benchmark; nulls, repeats, long texts and the like as in `scan`."""
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["n_words"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


#: The same by SQL joins: every window of every text, matched with every window of every item.
OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_SEPARATORS}'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(g) AS n, array_to_string(g, ' ') AS g FROM (SELECT item_id, w[i:i + 9] AS g FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT r, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM m WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
