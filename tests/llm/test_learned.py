import random
from zlib import crc32

import numpy as np
import pytest
from fixtures import documents, empty, words
from pyspark.sql import functions as F

from barloom.llm import langid, quality, toxicity

LETTERS = {"en": "th er on an".split(), "fr": "é ai eau oi".split(), "de": "sch ung ei ß".split()}


def speech(rnd, lang, n):
    return " ".join("".join(rnd.choice(LETTERS[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def held(i, mod, rest):
    return crc32(str(i).encode()) % mod == rest


@pytest.fixture(scope="module")
def toxic(spark):
    rnd = random.Random(1)
    bad = ["idiot", "moron", "worthless"]
    rows = []
    for i in range(600):
        text = words(rnd, rnd.randint(20, 200)).split()
        if i % 4 == 0:
            text.insert(rnd.randrange(len(text)), rnd.choice(bad).upper())
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t, "c") for i, t, _ in rows], "doc_id long, text string, score string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, None), (3, 0)], "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark, toxic):
    docs, labels = toxic
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model, ["doc_id"]).collect()
    right = [(r.score >= 0.3) == (r.doc_id % 4 == 0) for r in got if held(r.doc_id, 4, 2)]
    assert sum(right) / len(right) > 0.97
    odd = toxicity.score(documents(spark), model).collect()
    assert len(odd) == documents(spark).count() and all(0 <= r.score <= 1 for r in odd)
    again = toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"])
    assert sorted(r.score for r in again.collect()) == sorted(r.score for r in got)


def test_toxicity_does_not_learn_from_held_out_labels(spark, toxic):
    docs, labels = toxic
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, other)
    assert a.bias == b.bias and np.array_equal(a.weights, b.weights)


def test_classifiers_without_labels_or_classes(spark, toxic):
    docs, labels = toxic
    for module, name in ((toxicity, "toxic"), (quality, "quality")):
        own = labels.withColumnRenamed("toxic", name)
        none = module.score(docs, module.fit(docs, own.filter("false")), ["doc_id"])
        assert none.agg(F.max("score")).first()[0] < 0.01
        ones = module.score(docs, module.fit(docs, own.withColumn(name, F.lit(1))), ["doc_id"])
        assert ones.agg(F.min("score")).first()[0] > 0.99
        assert module.score(empty(spark), module.fit(empty(spark), own), ["doc_id"]).count() == 0


def test_quality_on_held_out_rows(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        text = words(rnd, rnd.randint(30, 200))
        rows.append((i, text if i % 3 else rnd.choice([text.upper(), text.replace(" ", "%%% "), "spam " * 50]), int(i % 3 > 0)))
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows], "doc_id long, text string, upper double")
    model = quality.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    got = quality.score(docs, model, ["doc_id", "upper"])
    assert got.columns == ["doc_id", "score"]
    right = [(r.score >= 0.3) == (r.doc_id % 3 > 0) for r in got.collect() if held(r.doc_id, 5, 0)]
    assert sum(right) / len(right) > 0.95 and 0 < len(model.rules) < 200
    odd = quality.score(documents(spark), model, ["doc_id"]).collect()
    assert len(odd) == documents(spark).count() and all(0 <= r.score <= 1 for r in odd)


def test_rules_mean_what_they_say(spark):
    model = quality.QualityModel(-1.0, [((("upper", True, 0.5), ("digit", False, 0.1)), 2.0), ((("n_words", False, 3.0),), -1.0)])
    rows = [(0.6, 0.0, 9.0), (0.6, 0.2, 1.0), (0.5, 0.0, 3.0)]
    frame = spark.createDataFrame(rows, "upper double, digit double, n_words double")
    got = [r.s for r in frame.select(model.column().alias("s")).collect()]
    want = [1 / (1 + np.exp(-(-1.0 + 2.0 * (u > 0.5 and d <= 0.1) - 1.0 * (n <= 3.0)))) for u, d, n in rows]
    assert np.allclose(got, want)


@pytest.mark.parametrize("n", [1, 2, 64, 65, 200])
def test_posteriors_against_log_sums(n):
    rnd = np.random.default_rng(n)
    k = 3
    emit, start, moves, first = rnd.normal(size=(n, k)), rnd.normal(size=k), rnd.normal(size=(k, k)), rnd.random(n) < 0.1
    first[0] = True
    got, pairs = langid.posteriors(emit, first, start, moves, pairs=True)
    want, wanted = np.zeros((n, k)), np.zeros((k, k))
    begins = [*np.flatnonzero(first), n]
    for a, b in zip(begins, begins[1:], strict=False):
        ahead, behind = np.zeros((b - a, k)), np.zeros((b - a, k))
        ahead[0] = start + emit[a]
        for t in range(1, b - a):
            ahead[t] = np.logaddexp.reduce(ahead[t - 1][:, None] + moves, axis=0) + emit[a + t]
        for t in range(b - a - 2, -1, -1):
            behind[t] = np.logaddexp.reduce(moves + emit[a + t + 1] + behind[t + 1], axis=1)
        both = ahead + behind
        want[a:b] = np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None])
        for t in range(b - a - 1):
            wanted += np.exp(ahead[t][:, None] + moves + emit[a + t + 1] + behind[t + 1] - np.logaddexp.reduce(ahead[-1]))
    assert np.allclose(got, want) and np.allclose(pairs, wanted)


@pytest.fixture(scope="module")
def chain(spark):
    rnd = random.Random(3)
    rows = [(i, speech(rnd, lang, 40), lang) for i in range(120) for lang in [list(LETTERS)[i % 3]]]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "th er", None)], "doc_id long, text string, lang string")
    return docs, langid.fit(docs)


def test_language_on_held_out_rows(spark, chain):
    docs, model = chain
    assert model.languages == ["de", "en", "fr"]
    got = langid.predict(docs, model).filter("lang IS NOT NULL AND text IS NOT NULL").collect()
    assert all(r.lang_pred == r.lang and r.score > 0.5 for r in got if held(r.doc_id, 3, 1))


def test_words_of_mixed_texts(chain):
    rnd = random.Random(4)
    text = f"{speech(rnd, 'en', 20)} {speech(rnd, 'fr', 20)}"
    labels = [lang for _, lang, _ in langid.word_labels(text, chain[1])]
    assert labels.count("en") >= 18 and labels.count("fr") >= 18 and set(labels[:15]) == {"en"}


def test_texts_without_letters_are_undetermined(spark, chain, monkeypatch):
    rows = [(1, None), (2, ""), (3, "123 !!! _ ٣"), (4, "数学")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, chain[1]).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] != "und"
    assert langid.keep_identified(docs, chain[1]).filter("doc_id < 4").count() == 0
    nothing = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(empty(spark), chain[1]).count() == 0
    assert len(langid.predict(documents(spark), chain[1]).collect()) == documents(spark).count()


def test_long_texts_are_labelled_in_runs(chain, monkeypatch):
    text = speech(random.Random(5), "de", 1000)
    whole = list(langid.word_runs(text))
    monkeypatch.setattr(langid, "RUN", 64)
    runs = list(langid.word_runs(text))
    assert len(whole) == 1 and len(runs) > 10 and sum(runs, []) == whole[0]


def plain_ngrams(text):
    folded = " " + " ".join("".join(chr(b) for b in (text or "").encode().translate(toxicity.FOLD)).split()) + " "
    found = set()
    for n in toxicity.ORDERS:
        for i in range(len(folded) - n + 1):
            mixed = n
            for c in folded[i : i + n]:
                mixed = (mixed * 16777619 % 2**32) ^ ord(c)
            found.add((mixed ^ mixed >> 15) * 2654435761 % 2**32 >> 32 - toxicity.BITS)
    return sorted(found)


@pytest.mark.parametrize("run", [7, 1 << 22])
def test_ngrams_against_plain_loops(run, monkeypatch):
    from barloom.llm import _common

    monkeypatch.setattr(_common, "RUN_BYTES", run)
    for text in ("You IDIOT, you!", "a b", "", None, "x", "ünï 123 --- é" * 5, " ".join(f"word{i}" for i in range(40))):
        assert toxicity.present(text).tolist() == plain_ngrams(text)


def test_toxicity_model_against_plain_counts(spark, toxic):
    docs, labels = toxic
    model = toxicity.fit(docs, labels, features=50)
    texts = {r.doc_id: r.text for r in docs.collect()}
    y = {}
    for r in labels.collect():
        if r.doc_id in texts and r.toxic is not None and not held(r.doc_id, 4, 2):
            y[r.doc_id] = max(r.toxic, y.get(r.doc_id, 0))
    grams = {d: set(plain_ngrams(texts[d])) for d in y}
    p, n = sum(y.values()), len(y) - sum(y.values())
    count = [[sum(g in grams[d] for d in y if y[d] == k) for k in (1, 0)] for g in model.buckets]
    ratios = [np.log((a + 1) / (p + 2)) - np.log((b + 1) / (n + 2)) for a, b in count]
    bias, weights = toxicity.logistic(50, [np.flatnonzero([g in grams[d] for g in model.buckets]) for d in sorted(y)], np.array([y[d] for d in sorted(y)], float), np.array(ratios))
    assert np.allclose(weights, model.weights, atol=1e-6) and abs(bias - model.bias) < 1e-6
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    for d, t in texts.items():
        total = model.bias + sum(w for g, w in zip(model.buckets, model.weights, strict=True) if g in set(plain_ngrams(t)))
        assert abs(got[d] - 1 / (1 + np.exp(-total))) < 1e-9


def plain_statistics(text):
    raw = (text or "").encode()
    if not raw:
        return [0.0] * 15
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, m = max(len(words), 1), max(len(lines), 1)

    def share(letters):
        return sum(c in letters for c in raw) / len(raw)

    top = max((words.count(w) for w in set(words)), default=0)
    return [
        len(words), sum(map(len, words)) / n, len(set(words)) / n, share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"), share(b"#$%&*+<=>@^_~{}[]\\/`!"), share(b".,;:?'\"()-"), share(b"|"), share(bytes(range(128, 256))),
        len(raw) / m, 1 - len(set(lines)) / m, sum(x.rstrip()[-1:] in b".!?" for x in lines) / m, top / n, sum(len(x) < 30 for x in lines) / m, sum(w[:1].isupper() for w in words) / n,
    ]


def test_statistics_against_plain_counts(spark, monkeypatch):
    from barloom.llm import _common

    texts = ["A b, C!\n\nA b, C!\nlast line without an end " + "x" * 40, " \n\t\n", "", None, "é|É #1\r\n" * 9, "one\x0btwo\x0cthree", "same " * 30 + "\n" + "a long line of more than sixteen bytes.\n" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.statistics(docs, ["doc_id"]).collect():
        assert np.allclose([r[s] for s in quality.STATISTICS], plain_statistics(texts[r.doc_id])), texts[r.doc_id]
    import pyarrow as pa

    monkeypatch.setattr(_common, "RUN_BYTES", 10)
    monkeypatch.setattr(quality, "RUN_BYTES", 10)
    rows = quality._statistics()(pa.record_batch([pa.array(texts)], names=["text"]))
    assert np.allclose(np.array([c.to_pylist() for c in rows]).T, [plain_statistics(t) for t in texts])


def test_rules_are_tree_paths_and_weights_are_sparse(spark):
    rnd = random.Random(5)
    rows = [(i, words(rnd, rnd.randint(5, 60)) + (" !!! ###" * 9 if i % 2 else ""), i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    names = set(quality.STATISTICS)
    assert all(w for _, w in model.rules) and all(0 < len(r) <= quality.DEPTH and {n for n, _, _ in r} <= names for r, _ in model.rules)
    got = {r.doc_id: r.score for r in quality.score(docs, model, ["doc_id"]).collect()}
    for i, t, _ in rows:
        own = dict(zip(quality.STATISTICS, plain_statistics(t), strict=True))
        total = model.bias + sum(w for rule, w in model.rules if all((own[n] > x) == above for n, above, x in rule))
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-9


def test_fits_are_bounded_with_repeated_ids(spark):
    docs = spark.createDataFrame([(7, f"text {i % 50}") for i in range(400)] + [(8, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 0)], "doc_id long, toxic int")
    found = toxicity.labelled(docs, labels, "toxic", 4, 9, 5)
    assert found.count() == 5 and {r.y for r in found.collect()} <= {0, 1}
