"""Quality: a sparse ensemble of rules over statistics of a text, compiled into Spark column expressions.

Shallow trees are grown on the statistics of labelled texts; each path from a root to a node is a conjunctive rule. A
logistic regression with an L1 penalty weighs the rules, most to zero. What is left is a Column: no model is called.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import RUN_BYTES, bucket_of, durable, table, token_runs, with_arrow_columns
from .toxicity import labelled

#: The fit takes at most so many labelled rows, those with the smallest hashes of doc_id.
TRAIN_ROWS = 8000
TREES, DEPTH = 20, 3
PENALTY = 0.002
STATISTICS = ("n_words", "word_len", "distinct", "upper", "digit", "symbol", "punct", "pipe", "non_ascii", "line_len", "line_repeats", "end_marks", "top_word", "short_lines", "capital_words")


#: Every kind of space as one.
BLANKS = bytes(32 if 9 <= c <= 13 else c for c in range(256))


def _lines(raw: bytes):
    """Lines of a text, one at a time."""
    at = 0
    while at <= len(raw):
        end = raw.find(b"\n", at)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end + 1


def _statistics():
    import numpy as np
    import pyarrow as pa

    kinds = np.zeros((256, 6))
    for column, letters in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*+<=>@^_~{}[]\\/`!", b".,;:?'\"()-", b"|", bytes(range(128, 256)))):
        kinds[list(letters), column] = 1

    def one(text) -> tuple:
        raw = (text.as_py() or "").encode()
        if not raw:
            return (0.0,) * len(STATISTICS)
        counts, letters, n_words, capital = np.zeros(256), 0, 0, 0
        seen: dict[bytes, int] = {}  # words, by digest if long
        for at in range(0, len(raw), RUN_BYTES):
            counts += np.bincount(np.frombuffer(raw, np.uint8, min(RUN_BYTES, len(raw) - at), at), minlength=256)
        for words in token_runs(raw.translate(BLANKS)):
            n_words += len(words)
            letters += sum(map(len, words))
            capital += sum(w[:1].isupper() for w in words)
            for w in words:
                w = w if len(w) <= 16 else hashlib.blake2b(w, digest_size=16).digest()
                seen[w] = seen.get(w, 0) + 1
        lines, ends, short, n_lines = set(), 0, 0, 0
        for x in _lines(raw):
            if bare := x.rstrip():
                n_lines += 1
                ends += bare[-1:] in b".!?"
                short += len(x) < 30
                lines.add(x if len(x) <= 16 else hashlib.blake2b(x, digest_size=16).digest())
        n, m = max(n_words, 1), max(n_lines, 1)
        upper, digit, symbol, punct, pipe, wide = (counts @ kinds) / len(raw)
        return (
            float(n_words), letters / n, len(seen) / n, upper, digit, symbol, punct, pipe, wide, len(raw) / m, 1 - len(lines) / m,
            ends / m, max(seen.values(), default=0) / n, short / m, capital / n,
        )

    def work(batch):
        rows = np.array([one(t) for t in batch.column("text")], float).reshape(batch.num_rows, len(STATISTICS))
        return [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(STATISTICS))]

    return work


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The `keep` columns of `docs` and STATISTICS of its whole `text`s; all are 0 for null and empty ones.

    Long texts are walked in runs of words and line by line; 16 bytes of each distinct word and line are held.
    """
    return with_arrow_columns(docs, ", ".join(f"`{s}` double" for s in STATISTICS), _statistics, keep)


Rule = tuple[tuple[str, bool, float], ...]


@dataclass
class QualityModel:
    bias: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The score as an expression over the statistics' columns."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def condition(rule: Rule) -> Column:
    found = F.lit(True)
    for name, above, threshold in rule:
        found = found & (F.col(name) > threshold if above else F.col(name) <= threshold)
    return found


def _paths(node, so_far: Rule, out: set) -> None:
    """Adds the rule of every node below a tree's root."""
    if so_far:
        out.add(so_far)
    if node.subtreeDepth() > 0:
        split = node.split()
        name, threshold = STATISTICS[split.featureIndex()], float(split.threshold())
        _paths(node.leftChild(), (*so_far, (name, False, threshold)), out)
        _paths(node.rightChild(), (*so_far, (name, True, threshold)), out)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> QualityModel:
    """Without labelled rows the model says 0 of every text; with one class only, that class's share."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    sample = durable(statistics(labelled(docs, labels, "quality", 5, 0, rows), ["y"]).coalesce(8))
    total, positive = sample.agg(F.count("*"), F.sum("y")).first()
    if not positive or positive == total:
        return QualityModel(50.0 if positive else -50.0, [])
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(sample)
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="onethird", subsamplingRate=0.8).fit(vectors)
    found: set[Rule] = set()
    for tree in forest.trees:
        _paths(tree._call_java("rootNode"), (), found)
    rules = sorted(found)
    if not rules:
        share = positive / total
        from math import log

        return QualityModel(log(share / (1 - share)), [])
    fired = sample.select(F.col("y").cast("double"), *[condition(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    fired = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(fired).select("x", "y")
    fired = durable(fired)
    lasso = LogisticRegression(featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=PENALTY, maxIter=60).fit(fired)
    return QualityModel(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w])


def score(docs: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """The `keep` columns and `score`, 0 to 1; those of `keep` named as a statistic or `score` are replaced.

    Null and empty texts get the score of statistics that are all 0. Rows are scored each by itself, repeated ones alike; an
    empty table gives an empty result.
    """
    counted = statistics(docs, keep)
    return counted.select(*[c for c in keep if c.lower() not in {*STATISTICS, "score"}], model.column().alias("score"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from labels that are not held out; nulls, repeats and the like as in `score`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
