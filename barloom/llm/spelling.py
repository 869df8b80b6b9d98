"""Spelling variants: words that differ by one letter are grouped around much more frequent ones.

Candidates come from a prefix filter on bigrams. One edit breaks at most two bigrams of a word, so if a word's bigrams are
ordered from the globally rarest on, two words at one edit share a bigram among the three rarest of each (and further places
of the third), at places that differ by no more than the lengths do. What is left of such a bigram or what is right of it
is the same in both words, as the edit lies on one side. So each of the three rarest files its word twice: under the letters
up to its end, and under those from its start on. Words meet by equal halves and fitting lengths only; those with letters that
one edit does not explain are passed over, and the distance is verified within the join: what comes out of it are links.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable, table

#: Fixed by the contract: letters, least length and occurrences, one of so many runs is damaged, how much more frequent a form is.
LETTERS = "[A-Za-zÀ-ÿ]"
LEAST_LETTERS, LEAST_COUNT, DAMAGED, TIMES = 7, 2, 31, 10
#: An edit breaks at most two bigrams, so one of any three is left.
PREFIX = 3
#: Distinct words that a task counts before it gives them out.
HELD_WORDS = 200_000
#: Rounds of following forms; each doubles the steps, and counts grow TIMES-fold at each step.
MOST_ROUNDS = 8


def _counted(least: int):
    """For a function over Arrow batches: the words of texts with how often each occurs, in parts."""

    def run(batches):
        import re
        from zlib import crc32

        import pyarrow as pa

        # A run is found whole or not at all, as a shorter one has no place where `least` letters begin.
        runs = re.compile(f"{LETTERS}{{{least},}}")
        lower = {c: c + 32 for c in range(65, 91)}

        def told(counts: Counter):
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                head = f"{doc_id.as_py()}:" if doc_id.is_valid else ":"
                own = Counter(m.group().translate(lower) for m in runs.finditer(text.as_py() or ""))
                for word, n in own.items():
                    h = crc32((head + word).encode())
                    if h % DAMAGED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    counts[word] += n
                if len(counts) > HELD_WORDS:
                    yield told(counts)
                    counts = Counter()
        if counts:
            yield told(counts)

    return run


def count_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words of `docs` (doc_id, text) with enough letters and occurrences.

    A word is a maximal run of letters with A-Z in lower case. In one of 31 pairs of document and run, by their crc32, a letter
    is left out: all occurrences of the run in the document change alike. Null texts have no words, and a null doc_id counts
    as empty text. Repeated rows count each. Counts are added up within a task before they are shuffled. Only the distinct
    words of one text are held besides HELD_WORDS.
    """
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    counted = named.mapInArrow(_counted(least_letters), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """Each bigram of `words` (word) and its place from the globally rarest on. There are at most the square of the alphabet, some
    8,000, in each task and on the driver."""

    def run(batches):
        import pyarrow as pa

        counts: Counter = Counter()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                counts.update(map(str.__add__, word, word[1:]))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])

    found = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r.gram: i for i, r in enumerate(sorted(found, key=lambda r: (r.n, r.gram)))}


def prefix(word: str, order: dict[str, int]) -> list[int]:
    """The places, from 0, of a word's PREFIX rarest bigrams, and of others equal to the last of these."""
    ranked = sorted((order[gram], p) for p, gram in enumerate(map(str.__add__, word, word[1:])))
    last = ranked[min(len(ranked), PREFIX) - 1][0]
    return [p for rank, p in ranked if rank <= last]


def letters_of(word: str) -> int:
    """64 bits: which letters a word has, and which an odd number of times, both modulo 32. One edit changes at most four."""
    have = odd = 0
    for c in map(ord, word):
        have |= 1 << c % 32
        odd ^= 1 << c % 32
    return have | odd << 32


def _filed(order: dict[str, int]):
    """For a function over Arrow batches: the halves beside each of a word's rarest bigrams, by hash, with the word's letters."""

    def halves(word: str, ends: list[int], seed: int):
        """Hashes of the first `end` letters for each of `ends`, each letter read once."""
        import xxhash

        state, at = xxhash.xxh64(seed=seed), 0
        for end in sorted(ends):
            state.update(word[at:end].encode())
            at = end
            yield state.intdigest()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            words, keys, letters = [], [], []
            for word in batch.column("word").to_pylist():
                places, back = prefix(word, order), len(word)
                own = {*halves(word, [p + 2 for p in places], 0), *halves(word[::-1], [back - p for p in places], 1)}
                keys += own
                words += [word] * len(own)
                letters += [letters_of(word)] * len(own)
            arrays = [pa.array([x - (x >> 63 << 64) for x in found], pa.int64()) for found in (keys, letters)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *arrays], names=["word", "key", "letters"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of `words` (word, n), distinct words of four letters or more, that are one inserted, deleted or
    replaced letter apart. With both counts, na and nb. Each pair once: the shorter is a, of equal lengths the smaller.

    No pair that is farther apart leaves the join, however many words meet under one key; those whose letters differ in too many
    ways are not even compared. Bounded by the links themselves.
    """
    filed = durable(words.select("word").mapInArrow(_filed(bigram_order(words)), "word string, key long, letters long"))
    longer = filed.select(F.col("key").alias("half"), F.length("word").alias("length"), F.col("word").alias("b"), F.col("letters").alias("others"))
    asked = filed.select("key", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size"), F.col("word").alias("a"), "letters")
    alike = F.bit_count(F.col("letters").bitwiseXOR(F.col("others"))) <= 4
    once = (F.col("size") > F.length("a")) | (F.col("a") < F.col("b"))
    met = asked.join(longer, (F.col("key") == F.col("half")) & (F.col("size") == F.col("length")) & alike & once & (F.levenshtein("a", "b", 1) == 1))
    pairs = met.select("a", "b").distinct()
    a, b = (words.select(F.col("word").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of `forms` (word, form; each word once): what is reached by following forms to the last.

    Steps are doubled each round. Forms must not lead back to their words; these cannot, as each is more frequent.
    """
    now = durable(forms.select("word", F.col("form").alias("root")))
    for _ in range(MOST_ROUNDS):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        if now.join(onward, "root", "left_semi").isEmpty():
            return now
        now = durable(now.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")))
    raise RuntimeError("forms lead too far")


def group_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of each of `words` (word, n; each word once, of four letters or more).

    form is the near word of largest n, of equals the smallest in code-point order, if that n is at least `times` the word's own; else
    null, as is form_n. n_near counts near words. root is the word itself where it has no form. An empty table gives an
    empty result. Letters are code points; words may be of any length.
    """
    words = durable(words)
    pairs = durable(near_words(words))
    ways = [F.struct(F.col(x).alias("word"), F.struct((-F.col(f"n{y}")).alias("less"), F.col(y).alias("form")).alias("other")) for x, y in ("ab", "ba")]
    best = pairs.select(F.explode(F.array(*ways)).alias("w")).select("w.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    formed = durable(words.join(best, "word", "left").withColumn("enough", -F.col("best.less") >= F.col("n") * times))
    formed = formed.select("word", F.when(F.col("enough"), F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("enough"), -F.col("best.less")).alias("form_n"))
    followed = formed.join(roots(formed.filter("form IS NOT NULL")), "word", "left")
    return followed.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents; nulls, repeats and the like as in `count_words` and `group_variants`."""
    return group_variants(count_words(table(spark, sf_dir, "documents")))


#: crc32 is written out (its table follows from the polynomial), and near words are found by blanking or leaving out each letter.
OP12_SQL = r"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY 1, 2),
k AS (SELECT run, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM r WHERE length(run) >= 7),
x AS (SELECT run, n, hex(encode(s)) AS hx FROM k),
e AS (SELECT run, n, list_transform(range(1, length(hx), 2), lambda i: (strpos('0123456789ABCDEF', hx[i]) - 1) * 16 + strpos('0123456789ABCDEF', hx[i + 1]) - 1) AS bytes FROM x),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, tab.crc[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM e, tab),
w AS (SELECT CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
b AS (SELECT word, n, i, word[1 : i - 1] || '*' || word[i + 1 :] AS blank, word[1 : i - 1] || word[i + 1 :] AS less FROM p),
q AS (SELECT a.word, c.word AS other FROM b a JOIN b c ON a.blank = c.blank AND a.word <> c.word UNION SELECT a.word, c.word FROM b a JOIN v c ON a.less = c.word UNION SELECT c.word, a.word FROM b a JOIN v c ON a.less = c.word),
g AS (SELECT q.word, count(*) AS n_near, min((-v.n, q.other)) AS best FROM q JOIN v ON v.word = q.other GROUP BY q.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 10 * v.n THEN best[2] END AS form, CASE WHEN -best[1] >= 10 * v.n THEN -best[1] END AS form_n FROM v LEFT JOIN g USING (word)),
z AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, z.root FROM f JOIN z ON f.form = z.word)
SELECT f.word, form, root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN z ON z.word = f.word
"""
