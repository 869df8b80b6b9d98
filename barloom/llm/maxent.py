"""Scores of whole texts under a hashed maximum-entropy language model, beside those of add-one counts.

The model gives each token P(class | context) * P(token | class, context), both softmaxes. The commonest tokens are put into
classes of CLASS_WORDS by frequency; every other token is of one of REST classes, by its ending, and within that class has
its smoothed share of all counts. Contexts are features: the token before, the one before that (a skip), both, and
their classes, each hashed into a row of weights for all outcomes. With no weights the model is that of the counts.

Counts cover all training texts. Weights are fitted on every token of every training text: tasks send what they
observe of each feature and outcome and what the model expects of it, and the driver, which has the two tables of weights and
nothing else, moves the weights by the gradient of the likelihood taken in logarithms, as iterative scaling does.

Counts of tokens are looked up in two ways: the HEAD commonest are sent to all tasks, and what a text has of others is joined
to the table of counts by hash. So neither grows with the vocabulary, and each token's count is exact.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import RUN_BYTES, bucket_of, durable, fresh_dir, fresh_name, remove, slices, table, token_runs, with_arrow_columns

#: Tokens whose counts every task holds, and tokens that the model has as words.
HEAD, WORDS = 131_072, 4_096
CLASS_WORDS, REST = 64, 32
#: Rows of weights for classes and for the words of a class.
BUCKETS = 8_192
#: The model's features: token before, token before that, both, and their classes.
FEATURES = 4
#: One token in STRIDE is fitted on, which is every token, a part of them in each of ROUNDS.
STRIDE, ROUNDS = 1, 4
RATE, DAMPING = 0.5, 3.0
#: Tokens that are worked on at once, and tokens besides the head whose hashes a task keeps.
BLOCK, HELD_TOKENS = 16_384, 400_000
#: Blocks of short texts whose numbers are made at once.
GROUP_BLOCKS = 16
#: Rows of outcomes that are worked out at once, so that they stay in a core's cache, and that are summed at once.
ROWS, SUMMED_ROWS = 2_048, 32_768
#: Bytes of fitted tokens that a task takes, at least and at most, those that it works on at once, and pieces in which it sends its sums.
FIT_BYTES, MOST_FIT_BYTES, FIT_TOKENS, PIECES = 16 << 20, 128 << 20, 1 << 19, 32
#: Rows for one place are summed in pieces of so many, then these sums.
FEW = 8
#: No word has a space in it.
END, START = b" ", b"  "
#: A-Z to lower case, and every kind of space to one.
LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
NO_WORD = 255


def tokens_of(text: str | None):
    """Lists of a text's tokens, one for each run of its words; the last one ends with END."""
    held = None
    for run in token_runs((text or "").encode().translate(LOWER)):
        if held is not None:
            yield held
        held = run
    yield [*(held or ()), END]


@dataclass
class MaxentModel:
    """tokens, counts: the head, commonest first. total, distinct: tokens (N) and distinct tokens (V) of the training texts.

    class_logs: log shares of all classes, those of words first. word_logs: log shares within classes of words. rest_logs: log10
    of what counts + 1 of the other classes' tokens are divided by. class_weights, word_weights: a row for each bucket.
    hashes, endings: of the head's tokens, so that no task hashes them again.
    """

    tokens: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    class_logs: np.ndarray
    word_logs: np.ndarray
    rest_logs: np.ndarray
    class_weights: np.ndarray
    word_weights: np.ndarray
    hashes: np.ndarray
    endings: np.ndarray

    @property
    def n_words(self) -> int:
        """Classes of words; the others follow, and after all of them that of START."""
        return len(self.word_logs)


def ending(token: bytes) -> int:
    """Which of the classes of tokens that are not words of the model."""
    return crc32(token[-3:]) % REST


def of_counts(head: list[tuple[bytes, int]], rest: dict[int, tuple[int, int]]) -> MaxentModel:
    """The model without weights, of the commonest tokens in order, and by ending of how many tokens and distinct ones there are."""
    import xxhash

    words = head[:WORDS]
    hashes, endings = np.array([xxhash.xxh64_intdigest(t, 42) for t, _ in head], np.uint64), np.array([ending(t) for t, _ in head], np.uint8)
    n_words = -(-len(words) // CLASS_WORDS)
    sums = np.array([rest.get(e, (0, 0)) for e in range(REST)], np.int64)
    total, distinct = (int(x) for x in sums.sum(axis=0))
    by_word = np.zeros((n_words, CLASS_WORDS))
    for i, (token, n) in enumerate(words):
        by_word[i // CLASS_WORDS, i % CLASS_WORDS] = n
        sums[ending(token)] -= n, 1
    by_class = np.concatenate([by_word.sum(axis=1), sums[:, 0]])
    class_logs = np.log((by_class + 1) / (total + len(by_class))).astype(np.float32)
    word_logs = np.log(np.maximum(by_word, 1e-30) / by_word.sum(axis=1, keepdims=True)).astype(np.float32)
    weights = np.zeros((BUCKETS, len(by_class)), np.float32), np.zeros((BUCKETS, CLASS_WORDS), np.float32)
    return MaxentModel([t for t, _ in head], np.array([n for _, n in head], np.int64), total, distinct, class_logs, word_logs, np.log10(sums.sum(axis=1) + 1.0), *weights, hashes, endings)


class Lexicon(dict):
    """Token to number, in the order of the head; START is after it, and tokens that are met get numbers from there on."""

    def __init__(self, model: MaxentModel):
        import pyarrow as pa
        import xxhash

        super().__init__(zip(model.tokens, range(len(model.tokens)), strict=True))
        self.start, self.n_words, self.words = len(model.tokens), model.n_words, min(len(model.tokens), WORDS)
        self._digest = xxhash.xxh64_intdigest
        space = self.start + HELD_TOKENS
        self.hashes, self.classes, self.places = np.zeros(space, np.uint64), np.zeros(space, np.uint8), np.full(space, NO_WORD, np.uint8)
        self.logs = np.zeros(space)  # log10 of counts + 1; of tokens beyond the head it is added elsewhere
        self.logs[: self.start] = np.log10(model.counts + 1.0)
        self.hashes[: self.start], self.classes[: self.start] = model.hashes, self.n_words + model.endings
        rank = np.arange(self.words)
        self.classes[: self.words], self.places[: self.words] = rank // CLASS_WORDS, rank % CLASS_WORDS
        self.room(3)
        self.classes[self[START]] = self.n_words + REST
        self.nothing, self.end = self[b""], self[END]
        self.kept, self._held = len(self), pa.array(list(self), pa.binary())

    def __missing__(self, token: bytes) -> int:
        i = self[token] = len(self)
        self.hashes[i], self.classes[i] = self._digest(token, 42), self.n_words + crc32(token[-3:]) % REST
        return i

    def room(self, n: int) -> None:
        """Makes room for n tokens more."""
        if len(self) + n > len(self.hashes):
            for name, value in (("hashes", 0), ("classes", 0), ("places", NO_WORD), ("logs", 0)):
                old = getattr(self, name)
                setattr(self, name, np.append(old, np.full(len(self) + n, value, old.dtype)))

    def numbers_of(self, tokens) -> np.ndarray:
        """Numbers of an Arrow array of distinct tokens. Those of tokens beyond the head are good until others are asked for."""
        import pyarrow as pa
        import pyarrow.compute as pc

        tokens = tokens.cast(pa.binary())
        found = pc.index_in(tokens, value_set=self._held)
        numbers, new = found.fill_null(-1).to_numpy().astype(np.int64), tokens.filter(found.is_null())
        self.room(len(new))
        first, end = len(self), len(self) + len(new)
        numbers[numbers < 0] = np.arange(first, end)
        new = new.to_numpy(zero_copy_only=False)
        self.hashes[first:end] = np.fromiter((self._digest(t, 42) for t in new), np.uint64, len(new))
        self.classes[first:end] = np.fromiter((crc32(t[-3:]) % REST for t in new), np.uint8, len(new)) + self.n_words
        return numbers

    def forget(self) -> None:
        """Drops what is beyond the head once that is too much. Numbers given before are void then."""
        if len(self) > self.kept + HELD_TOKENS:
            for token in list(self)[self.kept :]:
                del self[token]


def blocks(texts, lexicon: Lexicon):
    """(numbers, at, rows, places) of some BLOCK tokens at a time: numbers of tokens, two of context before each piece of a text among
    them; and of the tokens themselves where they are in these, the index of the text, and the place in it.

    Arrow splits the texts and tells distinct tokens, so that only these are looked up one by one. Long texts go in runs.
    """
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    long = pc.greater(pc.binary_length(texts), RUN_BYTES).to_numpy(zero_copy_only=False)
    short = np.flatnonzero(~long)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.take(short)))
    coded = lists.flatten().dictionary_encode()
    of_codes, codes, offsets = lexicon.numbers_of(coded.dictionary), coded.indices.to_numpy(), lists.offsets.to_numpy()
    first = 0
    while first < len(short):
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + GROUP_BLOCKS * BLOCK, "right")) - 1)
        own = of_codes[codes[offsets[first] : offsets[stop]]]
        real = own != lexicon.nothing  # before a leading space and after a trailing one
        n = np.diff(np.append(0, np.cumsum(real))[offsets[first : stop + 1] - offsets[first]]) + 1
        rows, last = np.repeat(np.arange(len(n)), n), np.cumsum(n) - 1
        at = np.arange(len(rows)) + 2 * (rows + 1)
        numbers, tokens = np.full(len(rows) + 2 * len(n), lexicon.start), np.ones(len(rows), bool)
        tokens[last] = False
        numbers[at[tokens]], numbers[at[last]] = own[real], lexicon.end
        places = np.arange(len(rows)) - (last - n + 1)[rows]
        rows = short[first + rows]
        for a in range(0, len(rows), BLOCK):
            yield numbers, at[a : a + BLOCK], rows[a : a + BLOCK], places[a : a + BLOCK]
        first = stop
    for row in np.flatnonzero(long):
        before, place = [START, START], 0
        for run in tokens_of(texts[row].as_py()):
            for first in range(0, len(run), BLOCK):
                part = run[first : first + BLOCK]
                lexicon.room(len(part) + 2)
                yield np.fromiter(map(lexicon.__getitem__, before + part), np.int64, len(part) + 2), np.arange(2, len(part) + 2), np.full(len(part), row), np.arange(place, place + len(part))
                before, place = (before + part)[-2:], place + len(part)
                lexicon.forget()


def features(numbers: np.ndarray, at: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """The buckets of the contexts of the tokens at places `at`, FEATURES for each."""
    last, skip = numbers[at - 1], numbers[at - 2]
    h1, h2 = lexicon.hashes[last], lexicon.hashes[skip]
    c1, c2 = lexicon.classes[last].astype(np.uint64), lexicon.classes[skip].astype(np.uint64)
    mixed = np.stack([h1, h2 ^ np.uint64(0x5851F42D4C957F2D), h1 * np.uint64(3) + h2 * np.uint64(0xD6E8FEB86659FD93), (c1 << np.uint64(8)) + c2 + np.uint64(1)], axis=1)
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % BUCKETS


def word_rows(buckets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The rows of word weights for contexts within classes."""
    return (buckets * 31 + classes[:, None] * 1_009) % BUCKETS


def unscaled(base: np.ndarray, factors: np.ndarray, buckets, out: np.ndarray | None = None, held: np.ndarray | None = None) -> np.ndarray:
    """Powers of the logits of all outcomes in each context, a row for each of `buckets`: shares times the powers of a few weights.

    Logits are logs of shares and a few weights, so their powers need no shift. They go to `out`; `held` has room for as many.
    """
    p = np.take(factors, buckets[0], axis=0, out=out, mode="clip")
    p *= base
    for own in buckets[1:]:
        p *= np.take(factors, own, axis=0, out=None if held is None else held[: len(own)], mode="clip")
    return p


def powers_of(model: MaxentModel) -> tuple[np.ndarray, ...]:
    """Shares of classes and of words within them, and the powers of both tables of weights."""
    return tuple(np.exp(x) for x in (model.class_logs, model.word_logs, model.class_weights, model.word_weights))


def add_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds each of `rows` to the row of `table` that `at` names. Rows of one place are summed first, FEW at a time, then their sums."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    at, held = at[order], np.empty((ROWS, rows.shape[1]), rows.dtype)
    while len(at):
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        last = np.append(first[1:], len(at))
        n = -(-(last - first) // FEW)
        place = np.repeat(np.arange(len(n)), n)
        begins = first[place] + FEW * (np.arange(len(place)) - (np.cumsum(n) - n)[place])
        size = np.minimum(last[place] - begins, FEW).astype(np.uint8)
        by = np.argsort(FEW - size, kind="stable")  # the longest pieces first
        sums = np.empty((len(by), rows.shape[1]), rows.dtype)
        for a in range(0, len(by), ROWS):
            own, out = by[a : a + ROWS], sums[a : a + ROWS]
            np.take(rows, order[begins[own]], axis=0, out=out, mode="clip")
            for turn in range(1, FEW):
                k = int(np.count_nonzero(size[own] > turn))
                if not k:
                    break
                out[:k] += np.take(rows, order[begins[own[:k]] + turn], axis=0, out=held[:k], mode="clip")
        if len(by) == len(first):
            table[at[begins[by]]] += sums
            return
        order = np.empty(len(by), np.int64)
        order[by] = np.arange(len(by))
        at, rows = at[begins], sums


def log_probabilities(powers: tuple[np.ndarray, ...], buckets: np.ndarray, classes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Natural logs of P(class | context), times P(word | class, context) for tokens that are words of the model (`powers_of`)."""
    of_classes, of_words, class_factors, word_factors = powers
    out = np.empty(len(classes))
    (p, held), (q, held_words) = (np.empty((2, ROWS, x.shape[1]), np.float32) for x in (class_factors, word_factors))
    for a in range(0, len(classes), ROWS):
        f, c, w = buckets[a : a + ROWS], classes[a : a + ROWS], places[a : a + ROWS]
        found = out[a : a + ROWS]
        of = unscaled(of_classes, class_factors, f.T, p[: len(c)], held)
        found[:] = of[np.arange(len(c)), c] / (of @ np.ones(of.shape[1], np.float32))
        own = np.flatnonzero(w != NO_WORD)
        if len(own):
            c = c[own]
            of = unscaled(np.take(of_words, c, axis=0), word_factors, word_rows(f[own], c).T, q[: len(c)], held_words)
            found[own] *= of[np.arange(len(c)), w[own]] / (of @ np.ones(of.shape[1], np.float32))
    return np.log(out)


def _trained(docs: DataFrame) -> DataFrame:
    return docs.filter(bucket_of("doc_id", 7) != 2)


def _counted(batches):
    """Batches (token, n) of what Arrow batches with text have: counted by Arrow within slices, these summed. Long texts go in runs."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def told(tokens, n):
        return pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), pa.array(n, pa.int64())], names=["token", "n"])

    def summed(parts):
        all_of = pa.Table.from_batches(parts)
        all_of = all_of.filter(pc.and_(pc.greater(pc.binary_length(all_of["token"]), 0), pc.greater(all_of["n"], 0)))  # nothing is before a leading space and after a trailing one
        found = all_of.group_by("token", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
        return told(found["token"].combine_chunks(), found["n_sum"].combine_chunks())

    counts, held, n = Counter(), [], 0
    for batch in batches:
        for part in slices(batch):
            text = pc.fill_null(part.column("text"), "")
            long = pc.greater(pc.binary_length(text), RUN_BYTES)
            for one in text.filter(long):
                for tokens in tokens_of(one.as_py()):
                    counts.update(tokens)
                    if len(counts) > HELD_TOKENS:
                        yield told(list(counts), list(counts.values()))
                        counts = Counter()
            short = text.filter(pc.invert(long))
            found = pc.value_counts(pc.ascii_split_whitespace(pc.ascii_lower(short)).flatten())
            counts[END] += len(short)
            held.append(told(found.field("values").cast(pa.binary()), found.field("counts")))
            n += len(found)
            if n > HELD_TOKENS:
                yield summed(held)
                held, n = [], 0
    if counts:
        held.append(told(list(counts), list(counts.values())))
    if held:
        yield summed(held)


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, n), token in bytes, over all texts: words with A-Z in lower case, and one END for each row. Counted within tasks first."""
    return docs.select("text").mapInArrow(_counted, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame, most: int = HEAD) -> list[tuple[bytes, int]]:
    """At most `most` tokens, each at least as common as any other, commonest first: those above a count that a histogram finds."""
    bins = counts.groupBy(F.floor(F.log2("n") * 16).alias("bin")).agg(F.count("*").alias("k"), F.min("n").alias("least")).orderBy(F.desc("bin")).collect()
    least, held = None, 0
    for b in bins:
        held += b.k
        if held > most:
            break
        least = b.least
    if least is None:
        return []
    return sorted(((bytes(r.token), r.n) for r in counts.filter(F.col("n") >= least).collect()), key=lambda r: (-r[1], r[0]))


def _fit_rows(model: MaxentModel):
    """For a function over Arrow batches: contexts and outcomes of every token (every STRIDE-th, if that is not 1), as bytes of 16-bit numbers, one column after the other, by round."""

    def run(batches):
        import pyarrow as pa

        lexicon = Lexicon(model)
        for batch in batches:
            for part in slices(batch):
                shift = np.array([crc32(str(i.as_py()).encode()) % (STRIDE * ROUNDS) for i in part.column("doc_id")])
                for numbers, at, rows, places in blocks(part.column("text"), lexicon):
                    turn = (places + shift[rows]) % (STRIDE * ROUNDS)
                    took = np.flatnonzero(turn % STRIDE == 0)
                    own = numbers[at[took]]
                    found = np.vstack([features(numbers, at[took], lexicon).T, lexicon.classes[own], lexicon.places[own]], dtype="<u2", casting="unsafe")
                    data = [found[:, np.flatnonzero(turn[took] == r * STRIDE)].tobytes() for r in range(ROUNDS)]
                    yield pa.RecordBatch.from_arrays([pa.array(range(ROUNDS), pa.int32()), pa.array(data, pa.binary())], names=["round", "data"])

    return run


def _moments(model: MaxentModel):
    """For a function over rows with data: pieces of four tables in one, of what is observed and expected of classes and of words.

    Tokens of one context have one expectation, which is worked out once and counts as often as there are tokens. Without weights
    it is the shares, whatever the context.
    """
    plain = not (model.class_weights.any() or model.word_weights.any())
    n_words, sizes = model.n_words, (len(model.class_logs), CLASS_WORDS)

    def gathered(rows):
        held, n = [], 0
        for row in rows:
            held.append(np.frombuffer(row.data, "<u2").reshape(FEATURES + 2, -1))
            n += held[-1].shape[1]
            if n >= FIT_TOKENS:
                yield np.concatenate(held, axis=1).astype(np.int64)
                held, n = [], 0
        if held:
            yield np.concatenate(held, axis=1).astype(np.int64)

    def observe(seen, rows, outcomes):
        for own in rows:
            seen += np.bincount(own * seen.shape[1] + outcomes, minlength=seen.size).reshape(seen.shape)

    def expect(expected, base, factors, rows, n, classes=None):
        """With `classes`, `base` has a row for each class."""
        p, held = (np.empty((k, base.shape[-1]), np.float32) for k in (min(len(n), SUMMED_ROWS), ROWS))
        for first in range(0, len(n), SUMMED_ROWS):
            end = min(first + SUMMED_ROWS, len(n))
            for a in range(first, end, ROWS):
                b = min(a + ROWS, end)
                of = unscaled(base if classes is None else np.take(base, classes[a:b], axis=0), factors, rows[:, a:b], p[a - first : b - first], held)
                of *= (n[a:b] / (of @ np.ones(of.shape[1], np.float32))).astype(np.float32)[:, None]
            for own in rows[:, first:end]:
                add_rows(expected, own, p[: end - first])

    def contexts(f, c):
        """Buckets of the distinct contexts and how many tokens have each; and those of contexts with a class of words."""
        key = f[0]
        for x in (*f[1:], c):
            key = key * BUCKETS + x if x is not c else key * (NO_WORD + 1) + x
        key, n = np.unique(key, return_counts=True)
        classes, key = key % (NO_WORD + 1), key // (NO_WORD + 1)
        own = np.stack([key // BUCKETS ** (FEATURES - 1 - k) % BUCKETS for k in range(FEATURES)])
        first = np.flatnonzero(np.append(True, np.diff(key) != 0))
        is_word = classes < n_words
        return (own[:, first], np.add.reduceat(n, first)), (own[:, is_word], classes[is_word], n[is_word])

    def run(rows):
        seen, expected = ([np.zeros((BUCKETS, k), np.float32) for k in sizes] for _ in range(2))
        of_classes, of_words, class_factors, word_factors = powers_of(model)
        of_classes, of_words = of_classes / of_classes.sum(), of_words / of_words.sum(axis=1, keepdims=True)
        some = False
        for data in gathered(rows):
            some = True
            f, c, w = data[:FEATURES], data[FEATURES], data[FEATURES + 1]
            own = np.flatnonzero(w != NO_WORD)
            places = word_rows(f[:, own].T, c[own]).T
            observe(seen[0], f, c)
            observe(seen[1], places, w[own])
            if plain:
                expected[0] += np.bincount(f.ravel(), minlength=BUCKETS)[:, None] * of_classes
                by_class = np.zeros((BUCKETS, n_words), np.float32)
                observe(by_class, places, c[own])
                expected[1] += by_class @ of_words
                continue
            (f, n), (g, c, m) = contexts(f, c)
            expect(expected[0], of_classes, class_factors, f, n)
            expect(expected[1], of_words, word_factors, word_rows(g.T, c).T, m, c)
        if some:
            yield from enumerate(np.array_split(np.concatenate([s.reshape(-1) for pair in zip(seen, expected) for s in pair]), PIECES))

    return run


def fit(docs: DataFrame) -> tuple[MaxentModel, DataFrame]:
    """The model of the texts of `docs` (doc_id, text), all of which are for training, and the table of counts (token, n).

    Null texts are empty; repeated rows count each. Without rows, all tokens are unknown. What comes to the driver are the head,
    sums of REST classes, and two tables of weights for each round.
    """
    spark = docs.sparkSession
    counts = durable(count_tokens(docs))
    by_ending = counts.groupBy((F.crc32(F.expr("substring(token, -3, 3)")) % REST).alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()
    model = of_counts(head_of(counts), {r.e: (r.n, r.k) for r in by_ending})
    if not model.total:
        return model, counts
    out = fresh_dir(spark, "maxent")
    docs.select("doc_id", "text").mapInArrow(_fit_rows(model), "round int, data binary").filter(F.length("data") > 0).write.partitionBy("round").option("compression", "zstd").parquet(out)
    taken = spark.read.schema("data binary, round int").parquet(out)
    n_bytes = {r["round"]: r.n for r in taken.groupBy("round").agg(F.sum(F.length("data")).alias("n")).collect()}
    for turn in sorted(n_bytes):
        # Each task sends two tables twice, so tasks grow once there are some for each core.
        tasks = min(-(-n_bytes[turn] // FIT_BYTES), max(2 * spark.sparkContext.defaultParallelism, -(-n_bytes[turn] // MOST_FIT_BYTES)))
        rows = taken.filter(F.col("round") == turn).select("data").coalesce(tasks)
        pieces = dict(rows.rdd.mapPartitions(_moments(model)).reduceByKey(np.add, PIECES).collect())
        remove(spark, f"{out}/round={turn}")
        sums = np.concatenate([pieces[i] for i in range(PIECES)])
        at = np.cumsum([model.class_weights.size] * 2 + [model.word_weights.size])
        seen, expected, seen_words, expected_words = np.split(sums, at)
        model.class_weights += RATE * np.log((seen + DAMPING) / (expected + DAMPING)).reshape(model.class_weights.shape)
        model.word_weights += RATE * np.log((seen_words + DAMPING) / (expected_words + DAMPING)).reshape(model.word_weights.shape)
    return model, counts


def _scores(model: MaxentModel):
    import pyarrow as pa

    lexicon, powers = Lexicon(model), powers_of(model)
    rest = np.concatenate([np.zeros(model.n_words), model.rest_logs])

    def work(batch):
        n = batch.num_rows
        sums, tail = np.zeros((4, n)), [[np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]]
        for numbers, at, rows, _ in blocks(batch.column("text"), lexicon):
            own = numbers[at]
            classes, places, logs = lexicon.classes[own].astype(np.int64), lexicon.places[own], lexicon.logs[own]
            found = log_probabilities(powers, features(numbers, at, lexicon), classes, places) / np.log(10)
            found += np.where(places == NO_WORD, logs - rest[classes], 0)
            known = own < lexicon.start
            for i, weights in enumerate((np.ones(len(own)), known, logs, found)):
                sums[i] += np.bincount(rows, weights, n)
            pairs, k = np.unique(rows[~known] * len(lexicon.hashes) + own[~known], return_counts=True)
            tail.append([pairs // len(lexicon.hashes), lexicon.hashes[pairs % len(lexicon.hashes)], k])
        row, token, k = (np.concatenate(x) for x in zip(*tail, strict=True))
        ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=n))), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(token.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(k, pa.int32()))]
        return [pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3]), *lists]

    return work


def score(docs: DataFrame, model: MaxentModel, counts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`docs` (with `text`), n_tokens, n_known, train_tokens, base_score and score: tokens, those that training texts have, tokens of these,
    and the log10 probability of the text by add-one counts and by the model.

    Null and wordless texts are END alone. Rows are scored each by itself, repeated ones alike, long texts in pieces that keep their
    context. New columns replace columns of their names. An empty table gives an empty result. Tokens beyond the head are told
    apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    kept = docs.columns if keep is None else keep
    row, tail = fresh_name(docs, "row"), fresh_name(docs, "tail")
    looked = with_arrow_columns(docs.select(*{*kept, "text"}), f"n_tokens long, n_known long, base_score double, score double, {tail} array<long>, {tail}_n array<int>", lambda: _scores(model), kept)
    out = fresh_dir(spark, "scores")
    looked.withColumn(row, F.monotonically_increasing_id()).write.parquet(out)
    looked = spark.read.parquet(out)
    asked = looked.select(F.col(row).alias("row"), F.explode(F.arrays_zip(F.col(tail).alias("h"), F.col(f"{tail}_n").alias("k"))).alias("t")).select("row", "t.h", "t.k")
    found = asked.join(counts.select(F.xxhash64("token").alias("h"), "n"), "h").groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("logs"))
    found = found.select(F.col("row").alias(row), F.col("more").alias(f"{row}_more"), F.col("logs").alias(f"{row}_logs"))
    more, logs = F.coalesce(f"{row}_more", F.lit(0)), F.coalesce(f"{row}_logs", F.lit(0.0))
    base = F.col("base_score") + logs - F.col("n_tokens") * F.log10(F.lit(float(model.total + model.distinct + 1)))
    own = [c for c in looked.columns if c not in (row, tail, f"{tail}_n", "n_tokens", "n_known", "base_score", "score", "train_tokens")]
    new = {"n_tokens": F.col("n_tokens"), "n_known": F.col("n_known") + more, "train_tokens": F.lit(model.total).cast("long"), "base_score": base, "score": F.col("score") + logs}
    return looked.join(found, row, "left").select(*own, *[c.alias(name) for name, c in new.items()])


def op11_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those that are not held out; nulls, repeats and the like as in `score`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = fit(_trained(docs))
    scored = score(docs, model, counts, ["doc_id"])
    return scored.select("doc_id", (bucket_of("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
