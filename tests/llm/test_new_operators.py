"""Language model, spelling variants and filter audit against plain Python."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from fixtures import documents, empty
from pyspark.sql import Row
from pyspark.sql import functions as F

from barloom.llm import filter_audit, maxent, spelling

# --- language model


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [t.encode() for t in re.findall(r"[^\x20\x09-\x0D]+", lower)] + [maxent.END]


def is_held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


@pytest.fixture(scope="module")
def prose(spark):
    rnd = random.Random(4)
    phrases = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "Eps", "ζeta"]) + rnd.choice(["", "", "s", "ing"]) for _ in range(6)) for _ in range(12)]
    rows = [(i, ". ".join(rnd.choice(phrases) for _ in range(rnd.randint(1, 40)))) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string").unionByName(documents(spark).select("doc_id", "text"))


def fitted(docs):
    return maxent.fit(maxent._trained(docs.select("doc_id", "text")))


@pytest.mark.parametrize("head", [5, maxent.HEAD])
def test_counts_and_base_scores_are_those_of_plain_python(spark, prose, monkeypatch, head):
    real = maxent.head_of
    monkeypatch.setattr(maxent, "head_of", lambda counts: real(counts, head))
    model, counts = fitted(prose)
    rows = [(r.doc_id, r.text) for r in prose.collect()]
    c = Counter(t for d, text in rows if not is_held(d) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    assert (model.total, model.distinct) == (n, v)
    assert len(model.tokens) <= head and all(c[t] == k for t, k in zip(model.tokens, model.counts, strict=True))
    assert {bytes(r.token): r.n for r in counts.collect()} == c
    got = maxent.score(prose.withColumn("score", F.lit("clash")).withColumn("row", F.lit("mine")).withColumn("tail", F.lit(1)), model, counts)
    want = sorted((-1 if d is None else d, len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 4)) for d, t in rows)
    found = got.collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in found) == want
    assert {(r.row, r.tail, r.train_tokens) for r in found} == {("mine", 1, n)} and all(r.score < 0 for r in found)


def test_scores_are_the_models_probabilities_token_by_token(prose):
    """Restated with exact softmaxes over all outcomes, one token at a time."""
    model, counts = fitted(prose)
    known = dict(zip(model.tokens, range(len(model.tokens)), strict=True))
    c = {bytes(r.token): r.n for r in counts.collect()}
    import xxhash

    def described(t):
        i = known.get(t, 1 << 40)
        h = xxhash.xxh64_intdigest(t, 42)
        return (h, model.n_words + maxent.REST, None) if t == maxent.START else (h, i // 64, i % 64) if i < maxent.WORDS else (h, model.n_words + zlib.crc32(t[-3:]) % maxent.REST, None)

    def buckets(one, two):
        m = 1 << 64
        mixed = [one[0], two[0] ^ 0x5851F42D4C957F2D, one[0] * 3 + two[0] * 0xD6E8FEB86659FD93, (one[1] << 8) + two[1] + 1]
        return [(x * 0x9E3779B97F4A7C15 % m >> 40) % maxent.BUCKETS for x in mixed]

    def softmax(z):
        e = np.exp(z.astype(float))
        return e / e.sum()

    text = "alpha beta gammas never-seen ζeta. Alpha"
    chain, want = [maxent.START, maxent.START, *tokens(text)], 0.0
    for two, one, t in zip(chain, chain[1:], chain[2:], strict=False):
        f = buckets(described(one), described(two))
        _, k, place = described(t)
        p = softmax(model.class_logs + sum(model.class_weights[b] for b in f))[k]
        if place is not None:
            p *= softmax(model.word_logs[k] + sum(model.word_weights[(b * 31 + k * 1009) % maxent.BUCKETS] for b in f))[place]
        else:
            p *= (c.get(t, 0) + 1) / 10 ** model.rest_logs[k - model.n_words]
        want += math.log10(p)
    one = prose.sparkSession.createDataFrame([(1, text)], "doc_id long, text string")
    assert maxent.score(one, model, counts).first().score == pytest.approx(want, abs=1e-4)


def test_classes_share_all_training_tokens(prose):
    model, counts = fitted(prose)
    rest = Counter()
    for r in counts.collect():
        if bytes(r.token) not in model.tokens[: maxent.WORDS]:
            rest[maxent.ending(bytes(r.token))] += r.n + 1
    assert np.allclose(10**model.rest_logs, [rest[e] + 1 for e in range(maxent.REST)])
    assert np.exp(model.class_logs.astype(float)).sum() == pytest.approx(1, abs=1e-4)
    assert np.allclose(np.exp(model.word_logs.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_context_helps_on_texts_that_were_held_out(spark, prose):
    model, counts = fitted(prose)
    flat = maxent.of_counts(list(zip(model.tokens, model.counts.tolist(), strict=True)), {r.e: (r.n, r.k) for r in counts.groupBy((F.crc32(F.expr("substring(token, -3, 3)")) % maxent.REST).alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()})
    held = prose.filter("doc_id < 300").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    with_context, without, base = (maxent.score(held, m, counts).agg(F.sum(x)).first()[0] for m, x in ((model, "score"), (flat, "score"), (model, "base_score")))
    assert with_context > without + 100 and without > base


def test_pieces_of_long_texts_keep_their_context(spark, prose, monkeypatch):
    model, counts = fitted(prose)
    rows = pa.array([("alpha beta unknown%d gammas " % (i % 7)) * 50 for i in range(3)])
    whole = [x for x in maxent._scores(model)(pa.record_batch([rows], names=["text"]))[3].to_pylist()]
    monkeypatch.setattr(maxent, "BLOCK", 7)
    monkeypatch.setattr(maxent, "HELD_TOKENS", 3)
    assert maxent._scores(model)(pa.record_batch([rows], names=["text"]))[3].to_pylist() == pytest.approx(whole, abs=1e-4)


def test_language_model_of_nothing(spark):
    nothing = empty(spark)
    model, counts = maxent.fit(nothing)
    assert maxent.score(nothing, model, counts).count() == 0
    row = maxent.score(documents(spark).filter("doc_id = 3"), model, counts).first()
    assert (row.n_known, row.base_score, row.train_tokens) == (0, 0.0, 0)


# --- spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def variants(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else 0) for w in counts)


def spelled(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += len(run) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


def listed(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_words_are_counted_as_plain_python_does(spark):
    docs = documents(spark, extra=["Älteste ÄLTESTE x×y÷zabc " * 9, "word" * 5_000 + " " + "word" * 5_000])
    docs = docs.unionByName(docs.filter("doc_id < 20"))
    assert {r.word: r.n for r in spelling.count_words(docs).collect()} == spelled([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("seed", range(4))
def test_variants_are_those_of_all_pairs(spark, seed):
    """Few letters, so that rarest bigrams repeat within words and tie; long chains of forms; a word with very many variants."""
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abñ" if seed % 2 else "abcdefgh") for _ in range(rnd.randint(4, 9))) for _ in range(25)]
    counts = {}
    for w in base * 6:
        for _ in range(rnd.randint(0, 3)):
            at, c = rnd.randrange(len(w)), rnd.choice("abñ")
            w = rnd.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])
        if len(w) >= 4:
            counts[w] = rnd.choice([2, 3, 20, 21, 300, 4_000, 50_000, 700_000])
    counts |= {"aaaaaaaa"[:i] + x + "aaaaaaaa"[i:]: 2 + i for i in range(9) for x in "bcdexyz"} | {"aaaaaaaa": 90, "aaaaaaa": 90, "aaaaaaaaa": 9_000}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert listed(spelling.group_variants(words)) == variants(counts)


def test_a_key_of_very_many_words_gives_links_only(spark):
    """All words share their three rarest bigrams, and none is near another."""
    rnd = random.Random(1)
    counts = {"qz" + "".join(rnd.choice("aeiou") for _ in range(12)) + "xw": 2 for _ in range(700)}
    found = listed(spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert found == variants(counts)


def test_spelling_of_nothing(spark):
    assert spelling.group_variants(spelling.count_words(empty(spark))).count() == 0
    assert spelling.group_variants(spelling.count_words(spark.createDataFrame([(1, "lonesome words twicefold twicefold")], "doc_id long, text string"))).collect()[0][:4] == ("twicefold", None, "twicefold", 2)


# --- audit


def audited(rows, labels):
    """part -> rows, all from the definitions."""
    first = {}
    for d, text, _ in rows:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    good, toxic = ({d for d, q, t in labels if (q, t)[i] == 1} for i in range(2))
    docs = []
    for d, text, lang in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and d > first[text]}
        docs.append((lang or "", {k for k, v in fails.items() if v}, d in good and d is not None, d in toxic and d is not None))
    out = []
    for part in {p for p, *_ in docs}:
        own = [x[1:] for x in docs if x[0] == part]
        made, total = [], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                total[f] += len(gone)
                failing = sum(f in x[0] for x in own)
                made.append(("".join(order), step, f, len(left), len(gone), failing - len(gone), sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out += [(part, o, s, *rest, total[f]) for o, s, f, *rest in made]
    return sorted(out)


def test_audit_is_that_of_applying_all_orders(spark):
    rnd = random.Random(3)
    long_ = " ".join(str(i) for i in range(260))
    extra = [long_, long_, long_ + " # five", "A B C D " * 80, long_.upper() + " LOUD" * 90, "same same " * 150, "same same " * 150] + [rnd.choice(["hot copy", long_, None, ""]) for _ in range(60)]
    docs = documents(spark, extra=extra).withColumn("mask", F.lit("clash")).withColumn("key", F.lit("clash"))
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 90, 2)] + [(4, 1, 0), (4, 0, 0), (None, 1, 1)]
    found = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in found.collect()) == audited(rows, labels)


def test_later_copies_are_found_across_tasks_and_shared_fingerprints(spark, monkeypatch):
    """All texts under one fingerprint; chains given out whenever they hold anything; string ids."""
    import xxhash

    monkeypatch.setattr(filter_audit, "CHAIN_BYTES", 300)
    rows = [(f"id{i % 90:02}", f"text {i % 17}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(7)
    least = {}
    for d, t in rows:
        least[t] = min(least.get(t, d), d)
    want = {(d, t) for d, t in rows if d > least[t]}
    names = {xxhash.xxh64_intdigest(t): t for t in least}
    found = [(r.doc_id, names[r.key % (1 << 64)]) for r in filter_audit.later_copies(docs, 5).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    chains = {}
    lost = [filter_audit._chain(chains, 7, t, d) for d, t in rows]
    assert {(x, t) for x, (_, t) in zip(lost, rows, strict=True) if x} == want and len(chains[7]) == 17


def test_audit_of_nothing(spark):
    assert filter_audit.audit(empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_every_token_is_fitted_on_once():
    texts = ["one two three four five six seven " * 9, None, "a b", ""]
    wanted = [len(tokens(t)) for t in texts]
    model = maxent.of_counts([(b"one", 9), (maxent.END, 4)], {})
    batch = pa.record_batch([pa.array([1, 2, 3, 4], pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    got = sum(len(d) for out in maxent._fit_rows(model)([batch]) for d in out.column("data").to_pylist())
    assert got == sum(wanted) * 2 * (maxent.FEATURES + 2)


def test_fitted_tokens_are_removed_and_tasks_are_bounded(spark, monkeypatch):
    """Nothing of the table of fitted tokens is left once each round has used its part, and tasks stay few, as each sends whole tables."""
    import glob

    from barloom.storage import shared_dir

    before = set(glob.glob(f"{shared_dir(spark)}/maxent-*/**/*.parquet", recursive=True))
    monkeypatch.setattr(maxent, "FIT_BYTES", 64)
    sent, real = spark.sparkContext.accumulator(0), maxent._moments

    def counted(model):
        work = real(model)

        def run(rows):
            sent.add(1)
            yield from work(rows)

        return run

    monkeypatch.setattr(maxent, "_moments", counted)
    docs = spark.createDataFrame([(i, f"one two three w{i % 5} " * 40) for i in range(200)], "doc_id long, text string").repartition(40)
    model, _ = maxent.fit(docs)
    assert model.total == 200 * 161 and model.class_weights.any()
    assert set(glob.glob(f"{shared_dir(spark)}/maxent-*/**/*.parquet", recursive=True)) <= before
    assert 0 < sent.value <= maxent.ROUNDS * 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("weighted", [False, True])
def test_moments_against_sums_token_by_token(weighted):
    rnd = np.random.default_rng(5)
    names = [f"t{i}".encode() for i in range(150)]
    model = maxent.of_counts([(t, 200 - i) for i, t in enumerate(names)], {e: (100_000, 900) for e in range(maxent.REST)})
    if weighted:
        model.class_weights[:], model.word_weights[:] = (rnd.normal(0, 0.4, w.shape) for w in (model.class_weights, model.word_weights))
    n = 300
    f = rnd.choice([3, 5, 8, 4000, 8191], (n, maxent.FEATURES))
    f[:200] = f[0]  # one context of many tokens
    rank = rnd.integers(0, 250, n)  # those from 150 on are of other classes
    c = np.where(rank < 150, rank // 64, model.n_words + rank % maxent.REST)
    w = np.where(rank < 150, rank % 64, maxent.NO_WORD)
    want = [np.zeros(x.shape) for x in (model.class_weights, model.class_weights, model.word_weights, model.word_weights)]
    for b, k, place in zip(f, c, w, strict=True):
        z = np.exp(model.class_logs + model.class_weights[b].sum(axis=0))
        for own in b:
            want[0][own, k] += 1
            want[1][own] += z / z.sum()
        if place != maxent.NO_WORD:
            own = (b * 31 + k * 1009) % maxent.BUCKETS
            z = np.exp(model.word_logs[k] + model.word_weights[own].sum(axis=0))
            for x in own:
                want[2][x, place] += 1
                want[3][x] += z / z.sum()
    rows = [Row(data=np.column_stack([f, c, w])[a : a + 100].astype("<u2").T.tobytes()) for a in range(0, n, 100)]
    got = np.concatenate([x for _, x in sorted(maxent._moments(model)(rows), key=lambda p: p[0])])
    assert np.allclose(got, np.concatenate([x.ravel() for x in want]), rtol=1e-3, atol=1e-3)


def test_tokens_are_counted_by_arrow_and_the_head_is_hashed_once(monkeypatch):
    """Only texts of more than a run of bytes are split word by word; tasks take hashes and endings of the head from the model."""
    texts = [" One\ttwo\x0bTWO\n", None, "", " \r ", "\xc9t\xe9 \x1fone\x0c\x0cone", "  x", "long " * 40]
    want = Counter(t for x in texts for t in tokens(x))
    real, split = maxent.tokens_of, []
    monkeypatch.setattr(maxent, "tokens_of", lambda text: (split.append(text), real(text))[1])
    monkeypatch.setattr(maxent, "RUN_BYTES", 100, raising=False)
    got = Counter()
    for out in maxent._counted([pa.record_batch([pa.array(texts, pa.string())], names=["text"])] * 2):
        got.update(dict(zip(out.column("token").to_pylist(), out.column("n").to_pylist(), strict=True)))
    assert got == Counter({t: 2 * n for t, n in want.items()}) and split == [texts[-1]] * 2
    head = sorted(want.items(), key=lambda r: (-r[1], r[0]))
    model = maxent.of_counts(head, {e: (100, 9) for e in range(maxent.REST)})
    monkeypatch.setattr(maxent, "ending", None)
    lexicon = maxent.Lexicon(model)
    assert [lexicon[t] for t, _ in head] == list(range(len(head))) and lexicon[maxent.START] == len(head)
    assert lexicon.hashes[: len(head)].tolist() == [xxhash.xxh64_intdigest(t, 42) for t, _ in head]
    new = lexicon[b"another"]
    assert lexicon.hashes[new] == xxhash.xxh64_intdigest(b"another", 42) and lexicon.classes[new] == model.n_words + zlib.crc32(b"her") % maxent.REST


@pytest.mark.parametrize("run_bytes", [12, 4 << 20])
@pytest.mark.parametrize(("block", "held"), [(3, 1), (3, 400_000), (16_384, 400_000)])
def test_texts_are_split_by_arrow_and_only_distinct_tokens_are_looked_up(monkeypatch, run_bytes, block, held):
    """Tokens, contexts and places are those of plain Python, batch after batch; only texts of more than a run of bytes go word by word."""
    texts = [" One\ttwo\x0bTWO\n", None, "", " \r ", "\xc9t\xe9 \x1fone\x0c\x0cone", "  x", "long Words " * 40, "one"]
    head = [(b"one", 9), (b"two", 4), (b"long", 2)]
    model = maxent.of_counts(head, {e: (100, 9) for e in range(maxent.REST)})
    real, split = maxent.tokens_of, []
    monkeypatch.setattr(maxent, "tokens_of", lambda text: (split.append(text), real(text))[1])
    monkeypatch.setattr(maxent, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(maxent, "BLOCK", block)
    monkeypatch.setattr(maxent, "HELD_TOKENS", held)
    lexicon = maxent.Lexicon(model)

    def told(texts):
        found = {}
        for numbers, at, rows, places in maxent.blocks(pa.array(texts, pa.string()), lexicon):
            for i, row, place in zip(at, rows.tolist(), places.tolist(), strict=True):
                assert (row, place) not in found
                found[row, place] = [(int(lexicon.hashes[x]), int(lexicon.classes[x]), int(lexicon.places[x]), x < lexicon.start) for x in numbers[i - 2 : i + 1]]
        return found

    def known(token):
        words = [t for t, _ in head]
        place = words.index(token) if token in words else maxent.NO_WORD
        kind = model.n_words + maxent.REST if token == maxent.START else 0 if token in words else model.n_words + zlib.crc32(token[-3:]) % maxent.REST
        return xxhash.xxh64_intdigest(token, 42), kind, place, token in words

    for part in (texts, ["new ones here and others", *texts[::-1]], [texts[6]], []):
        want = {}
        for row, text in enumerate(part):
            chain = [maxent.START] * 2 + tokens(text)
            want |= {(row, i): [known(t) for t in chain[i : i + 3]] for i in range(len(chain) - 2)}
        split.clear()
        assert told(part) == want
        assert split == [t for t in part if t and len(t.encode()) > run_bytes]


@pytest.mark.parametrize("n", [0, 1, 9, 5_000])
def test_rows_of_one_place_are_summed_in_pieces(monkeypatch, n):
    monkeypatch.setattr(maxent, "ROWS", 128)
    rnd = np.random.default_rng(3)
    at, rows = np.minimum(rnd.zipf(1.2, n), 299) - 1, rnd.random((n, 7), np.float32)
    table = rnd.random((300, 7), np.float32)
    want = table.astype(float)
    np.add.at(want, at, rows)
    maxent.add_rows(table, at, rows)
    assert np.allclose(table, want, rtol=1e-5)
