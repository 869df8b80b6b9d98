import hashlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from fixtures import documents, empty
from pyspark.sql import functions as F

from barloom.llm import exact_dedup, simhash, suffixes
from barloom.llm.components import connected_components
from barloom.llm.decontaminate import normal_words


def bare(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def exact_rows(rows):
    """What exact_groups should give of (doc_id, text) rows."""
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[bare(t)].append((-len(t or ""), d is None, d or 0, i))
    want = Counter()
    for i, (d, t) in enumerate(rows):
        best = min(groups[bare(t)])
        keep = None if best[1] else best[2]
        want[(d, keep, len(groups[bare(t)]), best[3] == i, hashlib.sha256(bare(t).encode()).hexdigest())] += 1
    return want


def test_exact_groups_against_a_dictionary(spark):
    docs = documents(spark).unionByName(spark.createDataFrame([(2000, "a b", "x", None, "1"), (2000, "a b", "y", None, "2"), (2000, " ab", "z", None, "3")], "doc_id long, text string, lang string, source string, size string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = exact_rows(rows)
    for capacity in (1, 3, 1000):
        got = exact_dedup.exact_groups(docs, capacity=capacity)
        assert Counter(tuple(r) for r in got.collect()) == want
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    texts = [bare(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({bare(t) for _, t in rows})  # one row of each group, repeats of doc_id and text too
    assert exact_dedup.exact_groups(empty(spark)).count() == 0 == exact_dedup.drop_copies(empty(spark)).count()


def test_kept_rows_keep_clashing_columns(spark):
    rows = [(str(i), t, i, i, i, i) for i, t in enumerate(["x y", "xy", "z", None, ""])]
    docs = spark.createDataFrame(rows, "doc_id string, text string, own_id int, own_digest int, own_id_gone int, row int")
    got = sorted(tuple(r) for r in exact_dedup.drop_copies(docs).collect())
    assert got == [rows[0], rows[2], rows[3]]


def test_colliding_keys_are_chained_and_told_apart(spark, monkeypatch):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(exact_dedup, "key_of", lambda bare: F.shiftleft(F.char_length(bare).cast("long") % 2, 63))
    index = exact_dedup.build(docs, capacity=1)
    assert index.directory.depth >= 1 and index.entries().select("key").distinct().count() == 2
    assert index.entries().groupBy("key").count().agg(F.max("count")).first()[0] > 5
    assert Counter(tuple(r) for r in exact_dedup.exact_groups(docs, capacity=1).collect()) == exact_rows(rows)


def test_equal_digests_of_different_bytes_are_noticed(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "ab"), (2, "cd")], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "key_of", lambda bare: F.lit(5).cast("long"))
    monkeypatch.setattr(exact_dedup, "digest_of", lambda bare: F.lit("same"))
    with pytest.raises(RuntimeError, match="bytes"):
        exact_dedup.build(docs)


def test_directory_doubles_and_splits_only_what_is_overfull(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("key"))
    found = exact_dedup.grown(keys, 100)
    assert sum(2.0**-local for _, local in found.buckets) == 1 and len(found.buckets) > 8
    sizes = found.place(keys).groupBy("bucket").count().collect()
    assert sum(r["count"] for r in sizes) == 1000 and all(r["count"] <= 100 for r in sizes)
    low = keys.select((F.shiftrightunsigned("key", 8)).alias("key"))  # all in the first of 256 ranges: one side is split
    one = exact_dedup.grown(low, 600)
    assert [local for _, local in one.buckets] == [9, 9, *range(8, 0, -1)]
    assert exact_dedup.grown(keys.limit(0), 100).buckets == [(0, 0)]


def test_results_are_looked_up_through_the_directory(spark):
    docs = documents(spark)
    index = exact_dedup.build(docs, capacity=4)
    files = index.entries().groupBy(F.input_file_name().alias("f")).agg(F.countDistinct("bucket").alias("n"), F.countDistinct("key").alias("keys")).collect()
    assert len(files) > 4 and all(f.n == 1 and f.keys <= 4 for f in files)  # an owner's file is one bucket
    assert index.lookup().count() == docs.count()
    index.directory = exact_dedup.Directory([(0, 0)])  # without the directory most rows do not find their bucket
    assert index.lookup().count() < docs.count()


def fingerprint(text):
    w = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    return {f: root(f) for f in fps}


def test_near_duplicates_against_all_pairs(spark):
    docs = documents(spark)
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    root = components({f for _, f in rows})
    least = {}
    for d, f in rows:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    want = Counter((d, f"{f:016x}", least.get(root[f])) for d, f in rows)
    for bucket in (64, 1):  # 1: all links through ball centres
        assert Counter(tuple(r) for r in simhash.near_duplicates(docs, bucket=bucket).collect()) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None} == set(least.values())
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_links_of_clustered_fingerprints(spark):
    import random

    rnd = random.Random(5)
    fps = set()
    for _ in range(6):
        centre = rnd.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(6))) for _ in range(60)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    want = components(fps)
    for bucket in (64, 2):
        edges = simhash.links(spark.createDataFrame(signed, "fp long"), bucket)
        roots = {r.node % (1 << 64): r.root for r in connected_components(edges).collect()}
        groups, wanted = defaultdict(set), defaultdict(set)
        for f in fps:
            groups[roots.get(f, f"alone {f}")].add(f)
            wanted[want[f]].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 400)] + [(1, i) for i in range(500, 600)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 401)} == {100} and {got[i] for i in range(500, 600)} == {1} and 7 not in got


def test_repeated_passages_against_a_dictionary(spark):
    docs = documents(spark).filter("doc_id IS NOT NULL")
    texts = {r.doc_id: normal_words(r.text) for r in docs.collect()}
    n, seen = suffixes.SHORTEST, defaultdict(set)
    for d, w in texts.items():
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])].add(d)
    want = defaultdict(set)
    for d, w in texts.items():
        for i in range(len(w) - n + 1):
            if len(seen[tuple(w[i : i + n])]) > 1:
                want[d].update(range(i, i + n))
    got = defaultdict(set)
    for r in suffixes.repeated_passages(docs).collect():
        got[r.doc_id].update(range(r.first_word, r.first_word + r.n_words))
        assert r.other_doc_id != r.doc_id
    assert got == want and len(want) > 5
    assert suffixes.repeated_passages(empty(spark)).count() == 0


def test_minimisers_are_in_every_window(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    grams = rnd.integers(0, 50, 500).astype(np.uint64)
    at = suffixes.minimisers(grams, 9)
    want = {j for i in range(len(grams) - 8) for j in range(i, i + 9) if grams[j] == grams[i : i + 9].min()}
    assert set(at.tolist()) == want
    assert suffixes.shared_words(b"aaaabbbbcccc", b"aaaabbbbdddd") == 2 and suffixes.shared_words(b"aaaa", b"aaaabbbb") == 1 and suffixes.shared_words(b"", b"a") == 0


def test_a_partner_hidden_by_nearer_neighbours_is_found(spark):
    import random

    rnd = random.Random(8)
    unique = iter(f"w{i}" for i in range(10**6))

    def noise(n):
        return [next(unique) for _ in range(n)]

    line = noise(100)
    texts = [line, noise(30) + line[20:75] + noise(30)]
    texts += [noise(40) + line[s : s + 46] + noise(40) for s in range(0, 54)]  # each shares more on one side, never enough
    rnd.shuffle(texts[2:])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.first_word, r.n_words, r.other_doc_id) for r in suffixes.repeated_passages(docs).collect())
    assert got == [(0, 20, 55, 1), (1, 30, 55, 0)]


def test_long_texts_are_hashed_in_runs(monkeypatch):
    import pyarrow as pa

    from barloom.llm import _common

    monkeypatch.setattr(_common, "RUN_BYTES", 20)
    texts = ["a", "a b", "a b c", "One two\tthree\nfour five six seven eight nine ten " * 20, "x" * 100, " ", None, "a  b   c    d" * 9]
    got = simhash._fingerprints(3)(pa.record_batch([pa.array(texts)], names=["text"]))[0].to_pylist()
    assert [g % (1 << 64) for g in got] == [fingerprint(t) for t in texts]
    assert len(suffixes._hashes("a b " * 100)) == 200 and len(suffixes._hashes(None)) == 0


def test_rounds_of_components_take_few_tasks_however_many_partitions_shuffles_have(spark):
    """Rounds on a few edges, in a session of 200 shuffle partitions that are not merged: once some 200 tasks in each of ten stages."""
    own = spark.newSession()
    for key, value in (("spark.sql.shuffle.partitions", "200"), ("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        own.conf.set(key, value)
    edges = own.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200)], "a long, b long")
    spark.sparkContext.setJobGroup("components", "components")
    got = connected_components(edges)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism
    assert {r.node: r.root for r in got.filter("node < 100").collect()} == dict.fromkeys(range(41), 0)
    tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    assert tasks < 200 * len(stages) / 4
