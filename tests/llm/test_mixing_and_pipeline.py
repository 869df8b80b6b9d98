import hashlib
import re
from collections import Counter, defaultdict

import pytest
from fixtures import documents, empty
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import langid, mixing, queries


def count(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def level(sizes):
    """Targets by resharing what is over the limit until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / open_ for s in order}
        over = {s for s in order if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def brute(rows):
    sizes = defaultdict(int)
    for _, source, n in rows:
        sizes[source] += n
    target = level(sizes)
    for source in sizes:
        own = sorted((hashlib.md5(f"mix:{'null' if d is None else d}".encode()).hexdigest(), d or 0, n, d) for d, s, n in rows if s == source)
        budget, before = int(target[source]), 0
        epochs = budget // sizes[source] if sizes[source] else 0
        for _, _, n, d in own:
            yield d, n, sizes[source], round(target[source], 6), epochs * n + min(max(budget - epochs * sizes[source] - before, 0), n)
            before += n


def test_mix_against_rounds(spark):
    docs = documents(spark)
    want = Counter(brute([(r.doc_id, r.source, count(r.text)) for r in docs.collect()]))
    got = mixing.mix(docs, keep=("doc_id", "size"))
    assert got.columns == ["doc_id", "size", "_size", "source_size", "target", "taken"]
    assert {r["size"] for r in got.collect()} == {"clash", None}
    assert Counter((r.doc_id, r["_size"], r.source_size, round(r.target, 6), r.taken) for r in got.collect()) == want
    by_source = mixing.mix(docs, keep=("source",)).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(r.t == int(r.g) for r in by_source)
    assert mixing.mix(docs).filter("taken > 2 * size").count() == 0
    again = mixing.mix(docs.repartition(3))
    assert again.exceptAll(mixing.mix(docs)).isEmpty()
    assert mixing.mix(empty(spark)).count() == 0
    assert [r.taken for r in mixing.mix(docs.filter("text IS NULL")).collect()] == [0]


def test_one_source_and_slots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "WINDOW_ROWS", 1)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    got = mixing.mix(docs)
    assert Counter(brute([(i, "s", 3) for i in range(300)])) == Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got.collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sf, duck, name):
    def rows(named):
        return Counter(str([(k, f"{v:.6f}" if isinstance(v, float) else str(v)) for k, v in sorted(r.items())]) for r in named)

    got = rows(r.asDict() for r in queries.queries()[name](spark, sf).collect())
    cursor = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert got == rows(dict(zip(names, r, strict=True)) for r in cursor.fetchall())


def test_pipeline_against_its_parts_in_plain_python(spark, sf):
    from test_dedup import bare
    from test_scans import brute as hits
    from test_shingles import jaccard_groups

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    chain = langid.fit(docs)
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, chain, ["doc_id"]).collect()}
    rows = {r.doc_id: r for r in docs.collect() if found[r.doc_id][0] != "und" and found[r.doc_id][1] >= corpus_pipeline.LEAST_POSTERIOR}
    best = {}
    for d, r in rows.items():
        key = bare(r.text)
        best[key] = min(best.get(key, (0, 1 << 62)), (-len(r.text or ""), d))
    rows = {d: rows[d] for _, d in best.values()}
    rows = {d: rows[d] for d in map(min, jaccard_groups({d: r.text for d, r in rows.items()}))}  # doc_ids are unique here
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {d: rows[d] for d, _, hit, _ in hits([(d, r.text) for d, r in rows.items()], items) if not hit}
    want = Counter(r for r in brute([(d, r.source, count(r.text)) for d, r in rows.items()]) if r[4])
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == want and len(want) > 20


def test_stages_keep_columns_and_their_values(spark, sf):
    names = ("spans", "items", "n_words", "lang_pred", "score", "lang_score", "own_id", "own_id_gone", "gone", "row", "at", "s", "size", "target", "taken", "bucket", "key", "scan_row")
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")) for n in names}).persist()
    assert docs.count() == 60
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[: len(docs.columns)] == docs.columns
        rows = out.select(*docs.columns)
        assert rows.count() > 20 and rows.exceptAll(docs).isEmpty()


def test_the_pipeline_gives_whole_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(docs, keep=tuple(docs.columns))
    assert got.select(*docs.columns).exceptAll(docs).isEmpty() and docs.exceptAll(got.select(*docs.columns)).isEmpty()
