"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are which of 2**BITS hashed n-grams of its normalised letters it has. On labelled rows the ratio
r = log(share of toxic texts with the n-gram / share of others) is taken; the FEATURES n-grams whose shares differ most
surely are kept, and a logistic regression is fitted on r times presence. Whole texts are scored, in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bucket_of, durable, table, token_runs, with_arrow_columns

BITS = 18
ORDERS = (3, 4, 5)
FEATURES = 4096
#: The fit takes at most so many labelled rows, those with the smallest hashes of doc_id.
TRAIN_ROWS = 6000
ROUNDS = 150
#: Bytes that n-grams are made of: lower-case letters, digits and whatever is not ASCII; all else is one space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def ngrams(text: str | None):
    """Arrays of the hashed n-grams of a text, repeats included, one array for each run of its words.

    A run begins with the last bytes of the one before it, so every n-gram is in one, and some short ones in two.
    """
    tail, last = b"", b" "
    for run in token_runs((text or "").encode().translate(FOLD)):
        folded = tail + b" " + b" ".join(run)
        tail, last = folded[1 - max(ORDERS) :], b""
        yield _hashed(folded)
    yield _hashed(tail + b" " + last)


def _hashed(folded: bytes) -> np.ndarray:
    letters = np.frombuffer(folded, np.uint8).astype(np.uint32)
    found = []
    for n in ORDERS:
        if len(letters) >= n:
            mixed = np.full(len(letters) - n + 1, n, np.uint32)
            for i in range(n):
                mixed = mixed * np.uint32(16777619) ^ letters[i : len(letters) - n + 1 + i]
            found.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(2654435761)) >> np.uint32(32 - BITS))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


@dataclass
class ToxicityModel:
    bias: float
    buckets: np.ndarray
    weights: np.ndarray


def present(text: str | None, used: np.ndarray | None = None) -> np.ndarray:
    """The distinct hashed n-grams of a text, in order; with `used`, a mark for each hash, only those marked."""
    parts = [np.unique(x if used is None else x[used[x]]) for x in ngrams(text)]
    return np.unique(np.concatenate(parts)).astype(np.int32)


def _presence():
    import pyarrow as pa

    return lambda batch: [pa.array([present(t.as_py()) for t in batch.column("text")], pa.list_(pa.int32()))]


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_out_mod: int, held_out: int, rows: int) -> DataFrame:
    """text and y of at most `rows` labelled rows that are not held out, those with the smallest hashes of doc_id.

    Of repeated labels the largest counts. Rows that share a doc_id count each, ordered by their texts.
    """
    picked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (bucket_of("doc_id", held_out_mod) != held_out))
    picked = picked.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most `rows` rows of two numbers
    return own.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(rows).select("text", "y")


def logistic(n: int, rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, rounds: int = ROUNDS, ridge: float = 1e-4) -> tuple[float, np.ndarray]:
    """Bias and weights of a ridge logistic regression on `scale` times presence, by full-batch adaptive steps."""
    index = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, first, second = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, rounds + 1):
        score = w[n] + np.bincount(row, (w[:n] * scale)[index], len(rows))
        error = 1 / (1 + np.exp(-np.clip(score, -50, 50))) - y
        slope = np.append(np.bincount(index, error[row], n) * scale / len(rows) + ridge * w[:n], error.mean())
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return float(w[n]), w[:n] * scale


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, features: int = FEATURES) -> ToxicityModel:
    """Without labelled rows the model says 0 of every text; with one class only, that class's share."""
    sample = durable(with_arrow_columns(labelled(docs, labels, "toxic", 4, 2, rows), "grams array<int>", _presence, ["y"]))
    total, positive = sample.agg(F.count("*"), F.sum("y")).first()
    positive = positive or 0
    if not positive or positive == total:
        return ToxicityModel(50.0 if positive else -50.0, np.zeros(0, np.int64), np.zeros(0))
    counts = sample.select("y", F.explode("grams").alias("gram")).groupBy("gram").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    p, n, big_p, big_n = F.col("p"), F.col("n"), F.lit(float(positive)), F.lit(float(total - positive))
    share = (p + n) / F.lit(float(total))
    surely = F.abs(p / big_p - n / big_n) / F.sqrt(share * (1 - share) + 1e-9)
    ratio = F.log((p + 1) / (big_p + 2)) - F.log((n + 1) / (big_n + 2))
    best = counts.filter(p + n >= 3).select("gram", ratio.alias("ratio"), surely.alias("surely")).orderBy(F.desc("surely"), "gram").limit(features).collect()
    buckets = np.array([r.gram for r in best], np.int64)
    order = np.argsort(buckets)
    buckets, scale = buckets[order], np.array([r.ratio for r in best])[order]
    data = _narrow(sample, buckets).collect()  # at most `rows` rows of the kept features
    bias, weights = logistic(len(buckets), [np.searchsorted(buckets, np.array(r.grams, np.int64)) for r in data], np.array([r.y for r in data], float), scale)
    return ToxicityModel(bias, buckets, weights)


def _narrow(sample: DataFrame, buckets: np.ndarray) -> DataFrame:
    def make():
        import pyarrow as pa

        held = np.zeros(1 << BITS, bool)
        held[buckets] = True

        def work(batch):
            rows = [np.asarray(g.values) for g in batch.column("grams")]
            return [pa.array([r[held[r]] for r in rows], pa.list_(pa.int32()))]

        return work

    return with_arrow_columns(sample, "grams array<int>", make, ["y"])


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """`docs` (with `text`) and `score`, 0 to 1. Null and empty texts get the score of no words at all.

    Rows are scored each by itself, repeated ones alike, long texts in runs of their words. A column named `score` is
    replaced. An empty table gives an empty result.
    """

    def make():
        import pyarrow as pa

        weights = np.zeros(1 << BITS, np.float64)
        weights[model.buckets] = model.weights
        used = weights != 0

        def one(text) -> float:
            total = model.bias + weights[present(text.as_py(), used)].sum()
            return 1 / (1 + float(np.exp(-np.clip(total, -50, 50))))

        return lambda batch: [pa.array([one(t) for t in batch.column("text")], pa.float64())]

    return with_arrow_columns(docs, "score double", make, keep)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from labels that are not held out; nulls, repeats and the like as in `score`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
