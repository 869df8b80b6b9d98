"""Language identification of words in code-switched text by a linear-chain conditional random field.

Each word has affix, n-gram, whole-word and lexicon features; the chain has learned start and transition weights. Forward
and backward sums label every word of a text, and a text's language is the one with the highest mean posterior.

The sums run in blocks: words of many texts are one chain in which a text's first word forgets what came before. Blocks
of STEPS words advance side by side, first as products of transition matrices, then, once the blocks' ends are joined, as
vectors. That is exact, and costs numpy calls for each step of a block, not for each word.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bucket_of, durable, fresh_name, table, with_arrow_columns

BITS = 16
STEPS = 64
#: The fit takes about so many texts of each language, chosen by a hash of doc_id and text, none longer than TRAIN_CHARS,
#: and at most MOST_TEXTS in all, those with the smallest hashes.
TRAIN_TEXTS = 120
TRAIN_CHARS = 50_000
MOST_TEXTS = 1_000
#: Rows of a language and a number that may be broadcast.
BROADCAST_LANGUAGES = 10_000
ROUNDS = 30
#: Words that are labelled at once, whole blocks of STEPS. The chain of a longer text is carried from run to run.
RUN = 1_500 * STEPS
#: Words whose weights a worker remembers.
CACHE = 250_000
#: A run of more letters than this is no word: it is read in pieces of so many, one after another, each labelled as a word.
PIECE = 100


def _unlettered() -> str:
    """Ranges, for a character class, of what Python's word class takes besides letters, digits and _: numerals such as ½ or ⅷ."""
    odd = (c for c in range(sys.maxunicode + 1) if (x := chr(c)).isalnum() and not x.isalpha() and not x.isdecimal())
    runs = ([c for _, c in g] for _, g in groupby(enumerate(odd), lambda p: p[1] - p[0]))
    return "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs)


WORD = re.compile(rf"[^\W\d_{_unlettered()}]{{1,{PIECE}}}")


def word_runs(text: str | None):
    """Lists of a text's words, or pieces of longer runs of letters, RUN at most in each.

    Words are found in the text as it is, then put in lower case, each by itself.
    """
    if not text:
        return
    # No word has a line feed, so lowering words joined by it is lowering each.
    if len(text) <= RUN:
        if words := WORD.findall(text):
            yield "\n".join(words).lower().split("\n")
        return
    found = WORD.finditer(text)
    while words := [m[0] for m in islice(found, RUN)]:
        yield "\n".join(words).lower().split("\n")


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of every feature of every word, by arrays over all letters of all words at once.

    A word's features are its n-grams of 2 and 3 letters, its ends being letters too, its first and last 3 letters, the whole
    word, its language in the lexicon if it has one, and one that all words share. All letters count.
    """
    marked = [f"^{w}$" for w in words]
    letters = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(sizes)
    begins, number = ends - sizes, np.arange(len(words))
    owner = np.repeat(number, sizes)
    place = np.arange(len(letters)) - begins[owner]
    left = sizes[owner] - place
    step = np.uint64(1_000_003)

    def bucket(mixed, kind):
        mixed = (mixed ^ np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)

    owners, buckets = [number], [np.zeros(len(words), np.int64)]
    run = letters
    for n in (2, 3, 4):
        run = run[:-1] * step + letters[n - 1 :]
        inside = left[: len(run)] >= n
        if n == 4:  # the marks make shorter ones of these n-grams of 2 and 3
            inside &= (place[: len(run)] == 0) | (left[: len(run)] == n)
        owners.append(owner[: len(run)][inside])
        buckets.append(bucket(run[inside], n))
    powers = np.cumprod(np.full(sizes.max(initial=0), step, np.uint64), dtype=np.uint64)
    owners.append(number)
    buckets.append(bucket(np.add.reduceat(letters * powers[place], begins), 5))
    own = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    if own:
        owners.append(np.array([i for i, _ in own]))
        buckets.append(bucket(np.array([k for _, k in own], np.uint64), 6))
    return np.concatenate(owners), np.concatenate(buckets)


def summed(owner: np.ndarray, bucket: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Each of n words' weights by language."""
    return np.stack([np.bincount(owner, weights[bucket, k], n) for k in range(weights.shape[1])], axis=1)


@dataclass
class Chain:
    """languages in order; weights by bucket and language; start and transition weights; word -> language of the lexicon."""

    languages: list[str]
    weights: np.ndarray
    start: np.ndarray
    moves: np.ndarray
    lexicon: dict[str, int]


@dataclass
class _Blocks:
    """Words in blocks of STEPS that are side by side: weights, which steps begin chains, each block's transition product."""

    weights: np.ndarray
    fresh: np.ndarray
    resets: list[np.ndarray]
    begin: np.ndarray
    move: np.ndarray
    whole: np.ndarray

    def product(self) -> np.ndarray:
        """The transition product of all blocks, scaled: rows are labels to, columns labels from."""
        found = np.eye(self.whole.shape[1])
        for block in self.whole:
            found = block @ found
            found /= found.sum()
        return found


def _blocks(emit: np.ndarray, first: np.ndarray, start: np.ndarray, moves: np.ndarray) -> _Blocks:
    n, labels = emit.shape
    blocks = -(-n // STEPS)
    size = blocks * STEPS
    e = np.ones((size, labels))
    e[:n] = np.exp(emit - emit.max(axis=1, keepdims=True))
    fresh = np.zeros(size, bool)
    fresh[:n] = first
    fresh[n : n + 1] = True  # what fills the last block is a chain of its own
    begin, move = np.exp(start - start.max()), np.exp(moves - moves.max())
    e = np.ascontiguousarray(e.reshape(blocks, STEPS, labels).transpose(1, 2, 0))  # step, label, block
    resets = [np.flatnonzero(r) for r in fresh.reshape(blocks, STEPS).T]
    product = np.repeat(np.eye(labels)[:, :, None], blocks, axis=2)  # to label, from label, block
    for t in range(STEPS):
        step = (move.T @ product.reshape(labels, -1)).reshape(labels, labels, blocks)
        if len(resets[t]):
            step[:, :, resets[t]] = product[:, :, resets[t]].sum(axis=0) * begin[:, None, None]
        step *= e[t][:, None, :]
        product = step / step.sum(axis=(0, 1)) if t % 8 == 7 else step
    return _Blocks(e, fresh, resets, begin, move, np.ascontiguousarray(product.transpose(2, 0, 1)))


def posteriors(emit: np.ndarray, first: np.ndarray, start: np.ndarray, moves: np.ndarray, pairs: bool = False, ahead_of: np.ndarray | None = None, behind_of: np.ndarray | None = None):
    """Posterior of each label for each word, and with `pairs` the expected number of each move.

    emit: (words, labels), log scale. first: whether a word begins a chain. start, moves: log weights. ahead_of is the
    forward vector of the words before these, of which the first word's chain is then a part; behind_of the backward one of
    those after these. Without them the words are all there are.
    """
    n, labels = emit.shape
    if ahead_of is None:
        first = first.copy()
        first[0] = True
    own = _blocks(emit, first, start, moves)
    e, fresh, resets, begin, move, whole = own.weights, own.fresh, own.resets, own.begin, own.move, own.whole
    blocks = len(whole)
    size = blocks * STEPS
    into, back = np.empty((labels, blocks)), np.empty((labels, blocks))
    vector = np.full(labels, 1 / labels) if ahead_of is None else ahead_of
    for b in range(blocks):
        into[:, b] = vector
        vector = whole[b] @ vector
        vector /= vector.sum()
    vector = np.ones(labels) if behind_of is None else behind_of
    for b in range(blocks - 1, -1, -1):
        back[:, b] = vector
        vector = vector @ whole[b]
        vector /= vector.sum()

    ahead, behind = np.empty_like(e), np.empty_like(e)
    for t in range(STEPS):
        step = move.T @ into
        if len(resets[t]):
            step[:, resets[t]] = into[:, resets[t]].sum(axis=0) * begin[:, None]
        step *= e[t]
        into = step / step.sum(axis=0)
        ahead[t] = into
    for t in range(STEPS - 1, -1, -1):
        behind[t] = back
        seen = e[t] * back
        step = move @ seen
        if len(resets[t]):
            step[:, resets[t]] = begin @ seen[:, resets[t]]
        back = step / step.sum(axis=0)

    def by_word(x):
        return x.transpose(2, 0, 1).reshape(size, labels)

    both = by_word(ahead * behind)[:n]
    both /= both.sum(axis=1, keepdims=True)
    if not pairs:
        return both
    left, right = by_word(ahead)[: n - 1], by_word(e * behind)[1:n]
    inside = ~fresh[1:n]
    left, right = left[inside], right[inside]
    weight = ((left @ move) * right).sum(axis=1, keepdims=True)
    return both, move * ((left / weight).T @ right)


def fit_chain(texts: list[tuple[str, str]], rounds: int = ROUNDS) -> Chain:
    """The chain of (language, text) pairs. Words get their text's language; every second text continues the chain of the
    one before it, so moves between languages are learned too."""
    languages = sorted({lang for lang, _ in texts})
    number = {lang: i for i, lang in enumerate(languages)}
    words, label, first = [], [], []
    for i, (lang, text) in enumerate(texts):
        own = [w for run in word_runs(text) for w in run]
        words += own
        label += [number[lang]] * len(own)
        first += [j == 0 and i % 2 == 0 for j in range(len(own))]
    if not words:
        return Chain(languages, np.zeros((1 << BITS, len(languages))), np.zeros(len(languages)), np.zeros((len(languages),) * 2), {})
    kinds: dict[str, int] = {}
    ids = np.fromiter((kinds.setdefault(w, len(kinds)) for w in words), np.int64, len(words))
    y, first = np.array(label), np.array(first)
    n, labels = len(words), len(languages)
    counts = np.stack([np.bincount(ids[y == k], minlength=len(kinds)) for k in range(labels)], axis=1)
    sure = (counts.sum(axis=1) >= 5) & (counts.max(axis=1) >= 0.9 * counts.sum(axis=1))
    best = counts.argmax(axis=1)
    lexicon = {w: int(best[i]) for w, i in kinds.items() if sure[i]}
    owner, bucket = features(list(kinds), lexicon)
    heads = np.zeros(labels)
    np.add.at(heads, y[first], 1)
    moved = np.zeros((labels, labels))
    np.add.at(moved, (y[:-1][~first[1:]], y[1:][~first[1:]]), 1)
    weights, start, moves = np.zeros((1 << BITS, labels)), np.zeros(labels), np.zeros((labels, labels))
    memory = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, start, moves)]
    truth = np.eye(labels)[y]
    for step in range(1, rounds + 1):
        emit = summed(owner, bucket, weights, len(kinds))[ids]
        both, pair = posteriors(emit, first, start, moves, pairs=True)
        off = truth - both
        by_word = np.stack([np.bincount(ids, off[:, k], len(kinds)) for k in range(labels)], axis=1)
        slope = np.stack([np.bincount(bucket, by_word[owner, k], 1 << BITS) for k in range(labels)], axis=1)
        slopes = (slope / n - 1e-6 * weights, (heads - both[first].sum(axis=0)) / n - 1e-6 * start, (moved - pair) / n - 1e-6 * moves)
        for value, g, (m, v) in zip((weights, start, moves), slopes, memory, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            value += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(languages, weights.astype(np.float32), start, moves, lexicon)


def fit(docs: DataFrame, texts: int = TRAIN_TEXTS, most: int = MOST_TEXTS) -> Chain:
    """The chain of a sample of `docs` (doc_id, text, lang) that are not held out; rows without text or lang are skipped.

    At most `most` texts, of TRAIN_CHARS characters at most, reach the driver, however many languages there are and however
    often a row is repeated. A language without a text in the sample is not learned.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket_of("doc_id", 3) != 1)).select("doc_id", "text", "lang")
    rows = rows.filter(F.char_length("text") <= TRAIN_CHARS).withColumn("h", F.xxhash64(F.lit("langid"), "doc_id", "text"))
    share = durable(rows.groupBy("lang").agg((F.lit(float(texts)) / F.count("*")).alias("share")))
    if share.count() <= BROADCAST_LANGUAGES:
        share = F.broadcast(share)
    chance = F.pmod("h", F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.join(share, "lang").filter(chance < F.col("share"))
    found = sample.orderBy("h", "lang", "text").limit(most).select("lang", "text").collect()
    return fit_chain([(r.lang, r.text) for r in found])


class _Labeller:
    """Posterior means of texts; remembers the weights of the words it has seen."""

    def __init__(self, chain: Chain):
        self.chain, self.known, self.table = chain, {}, np.zeros((CACHE, len(chain.languages)))

    def emit(self, words: list[str]) -> np.ndarray:
        if len(self.known) + len(words) > CACHE:
            self.known.clear()
        known = self.known
        if new := [w for w in dict.fromkeys(words) if w not in known]:
            at = len(known)
            known.update(zip(new, range(at, at + len(new)), strict=True))
            self.table[at : at + len(new)] = summed(*features(new, self.chain.lexicon), self.chain.weights, len(new))
        return self.table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def runs(self, text: str | None):
        """(words, posteriors) of each run of a text's words: one chain, however long.

        A long text's runs are walked twice. First each run's transition product is taken; from these come the forward
        vector before each run and the backward one after it, a few numbers each.
        """
        chain = self.chain
        runs = word_runs(text)
        head = list(islice(runs, 2))
        if len(head) < 2:
            for words in head:
                yield words, posteriors(self.emit(words), np.zeros(len(words), bool), chain.start, chain.moves)
            return

        def begun(number: int, words: list[str]) -> np.ndarray:
            first = np.zeros(len(words), bool)
            first[0] = number == 0
            return first

        products = [_blocks(self.emit(w), begun(i, w), chain.start, chain.moves).product() for i, w in enumerate(word_runs(text))]
        ahead, behind = [np.full(len(chain.languages), 1 / len(chain.languages))], [np.ones(len(chain.languages))]
        for product in products[:-1]:
            ahead.append(product @ ahead[-1])
            ahead[-1] /= ahead[-1].sum()
        for product in reversed(products[1:]):
            behind.append(behind[-1] @ product)
            behind[-1] /= behind[-1].sum()
        for i, (words, before, after) in enumerate(zip(word_runs(text), ahead, reversed(behind), strict=True)):
            yield words, posteriors(self.emit(words), begun(i, words), chain.start, chain.moves, ahead_of=before, behind_of=after)

    def means(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Sums of posteriors and numbers of words, by text. Short texts are labelled together."""
        texts = list(texts)
        sums, counts = np.zeros((len(texts), len(self.chain.languages))), np.zeros(len(texts), np.int64)
        emit, first, owners, held = [], [], [], 0

        def flush():
            nonlocal emit, first, owners, held
            if held:
                begins = np.zeros(held, bool)
                begins[first] = True
                both = posteriors(np.concatenate(emit), begins, self.chain.start, self.chain.moves)
                sums[owners] = np.add.reduceat(both, first, axis=0)
            emit, first, owners, held = [], [], [], 0

        for i, text in enumerate(texts):
            own = text.as_py()
            if own and len(own) > RUN:
                for words, both in self.runs(own):
                    sums[i] += both.sum(axis=0)
                    counts[i] += len(words)
                continue
            for words in word_runs(own):  # one run, or none
                if held + len(words) > RUN:
                    flush()
                emit.append(self.emit(words))
                first.append(held)
                owners.append(i)
                held += len(words)
                counts[i] += len(words)
        flush()
        return sums, counts


def predict(docs: DataFrame, chain: Chain, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` (with `text`) and lang_pred, score: the language with the highest mean posterior over a text's words.

    Null texts and texts without a letter are `und` with score 0, and so is everything if nothing was learned from. Of
    languages with equal means the first by code points is taken. Each row is labelled by itself, repeated ones alike; an
    empty table gives an empty result. `names` are the new columns' names; columns of `docs` with these are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def make():
        import pyarrow as pa

        labeller = _Labeller(shared.value) if shared.value.languages else None
        names = np.array([*shared.value.languages, "und"], object)

        def work(batch):
            if labeller is None:
                return [pa.array(["und"] * batch.num_rows), pa.array([0.0] * batch.num_rows)]
            sums, counts = labeller.means(batch.column("text"))
            best = np.where(counts > 0, sums.argmax(axis=1), len(names) - 1)
            score = np.where(counts > 0, sums.max(axis=1) / np.maximum(counts, 1), 0.0)
            return [pa.array(names[best], pa.string()), pa.array(np.clip(score, 0.0, 1.0))]

        return work

    return with_arrow_columns(docs, f"`{names[0]}` string, `{names[1]}` double", make, keep)


def word_labels(text: str, chain: Chain) -> list[tuple[str, str, float]]:
    """(word, language, posterior) of each word of one text: the operator's own view of code-switched text."""
    found = []
    for words, both in _Labeller(chain).runs(text):
        found += [(w, chain.languages[k], float(p[k])) for w, p, k in zip(words, both, both.argmax(axis=1), strict=True)]
    return found


def keep_identified(docs: DataFrame, chain: Chain, least: float = 0.5) -> DataFrame:
    """The rows of `docs`, in all their columns, whose language is known with a mean posterior of `least` or more."""
    lang, score = fresh_name(docs, "lang_pred"), fresh_name(docs, "lang_score")
    found = predict(docs, chain, names=(lang, score))
    return found.filter((F.col(lang) != "und") & (F.col(score) >= least)).select(*docs.columns)


def op8_langid(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out; nulls, ties and the like as in `predict`."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fit(docs), ["doc_id"])
    return found.select("doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
