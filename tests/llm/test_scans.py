import base64
import hashlib
import math
import re
from collections import Counter

import pytest
from fixtures import documents, empty, words

from barloom.llm import decontaminate, licenses, warc

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def tokens(t):
    return WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))


def test_licences_against_every_place(spark):
    extra = ["GNU General Public License gnu general public license; Apache  LICENSE", "cc-by cc by by cc by", "mit license mit license mit", "license mit", "public license", "Permission is hereby granted, free of charge, to anyone", "general public license", "x GNU GENERAL PUBLIC LICENSE, version 3", f"Copyright 2020 X\n\n{licenses.MIT}", licenses.BSD_HEAD + licenses.BSD_NAMES + licenses.BSD_TAIL, licenses.MIT.replace("NO EVENT", "ANY EVENT"), licenses.GPL]
    docs = documents(spark, extra=extra)
    index = licenses.build_index(licenses.document_frequencies(docs))
    want = Counter()
    for r in docs.collect():
        w = tokens(r.text)
        found = [(i, label) for phrase, label in BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in found]
        want[(r.doc_id, len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))] += 1
    got = licenses.scan(docs, index).collect()
    assert Counter(tuple(r)[:6] for r in got) == want
    by_text = {r.doc_id: r for r in got}
    first = docs.count() - 2 - len(extra)
    assert by_text[first + 5].labels == "mit" and by_text[first + 5].base_labels == "" and 0 < by_text[first + 5].score <= 1
    assert by_text[first + 7].labels == "gpl,gpl-3.0"
    assert by_text[first + 8].labels == "mit" and by_text[first + 8].score == 1.0
    assert by_text[first + 9].labels == "bsd,bsd-3-clause" and by_text[first + 11].labels == "gpl,gpl-3.0"
    assert licenses.scan(empty(spark), licenses.build_index(licenses.document_frequencies(empty(spark)))).count() == 0
    assert licenses.scan(docs.withColumnRenamed("size", "score"), index, keep=("doc_id", "score")).columns.count("score") == 1


BSD_3 = licenses.BSD_HEAD + licenses.BSD_NAMES + licenses.BSD_TAIL
#: As they are met in files: a word more, a name in place of another, no list numbers, a copyright line.
VARIANTS = {
    "mit": licenses.MIT.replace("without limitation the rights", "without any limitation the rights"),
    "bsd,bsd-3-clause": BSD_3.replace("the copyright holder nor", "Acme Inc nor"),
    "bsd,bsd-3-clause ": "(c) 1999 Acme\n" + BSD_3.replace("3. ", "* ").replace("1. ", "* ").replace("2. ", "* "),
    "bsd,bsd-2-clause": (licenses.BSD_HEAD + licenses.BSD_TAIL).replace("1. ", "").replace("2. ", ""),
    "zlib": licenses.ZLIB.replace("1. ", "").replace("2. ", "").replace("3. ", ""),
    "isc": licenses.ISC.replace("and/or distribute", "and or distribute").replace("THE AUTHOR DISCLAIMS", "ACME AND ITS AUTHORS DISCLAIM"),
}


def test_licences_as_they_are_met_in_files(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(VARIANTS.values())], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs, licenses.build_index(licenses.document_frequencies(docs))).collect()}
    assert [got[i].labels for i in range(len(VARIANTS))] == [k.strip() for k in VARIANTS]
    assert all(r.score > 0.9 and r.places for r in got.values())


def judged(texts, templates=licenses.TEMPLATES):
    """(labels, score) of each text, every template being laid on every place of it."""
    n = len(texts)
    split = [tokens(t) for t in texts]
    seen = [set(w) for w in split]
    weight = {x: math.log((n + 1) / (sum(x in s for s in seen) + 1)) + 1 for t in templates for x in t.words()}
    for w in split:
        labels, best = set(), 0.0
        for t in templates:
            own, keys = t.words(), t.key_places()
            rare = sorted({x for _, k in keys for x in k}, key=lambda x: (-weight[x], x))[:2]
            place = {x: min(at + i for at, k in keys for i, y in enumerate(k) if x == y) for x in rare}
            for start in range(len(w)):
                here = w[start : start + len(own)]
                if all(w[start + at : start + at + 1] == [x] for x, at in place.items()):
                    share = sum(weight[x] for x, y in zip(own, here, strict=False) if x == y) / sum(weight[x] for x in own)
                    sure = all(w[start + at : start + at + len(k)] == k for at, k in keys)
                    best = max(best, share * (1 if sure else licenses.PARTIAL))
                    labels |= {t.label} if sure else set()
            if len(keys) > 1:  # all phrases in order, about as far apart as in the template
                ways = [(i, i) for i in range(len(w)) if w[i : i + len(keys[0][1])] == keys[0][1]]
                for (a, _), (b, k) in zip(keys, keys[1:], strict=False):
                    slack = licenses.SLACK + int(licenses.SLACK_SHARE * (b - a))
                    ways = [(first, j) for first, i in ways for j in range(i + max(1, b - a - slack), i + b - a + slack + 1) if w[j : j + len(k)] == k]
                for first, at in ways:
                    here = set(w[max(first - keys[0][0], 0) : at + len(own) - keys[-1][0]])
                    best = max(best, sum(weight[x] for x in set(own) & here) / sum(weight[x] for x in set(own)))
                    labels.add(t.label)
        yield ",".join(sorted(labels)), best


def test_labels_and_scores_against_every_template_at_every_place(spark):
    extra = [licenses.MIT, f"x {licenses.ISC} y", licenses.APACHE.upper(), licenses.GPL + licenses.ZLIB, licenses.UNLICENSE[:90], "mozilla public license cc by sa", "Licensed under CC BY-NC 4.0", licenses.BSD_HEAD + licenses.BSD_TAIL.replace("POSSIBILITY", "chance"), *VARIANTS.values(), licenses.ZLIB + " " + VARIANTS["zlib"], VARIANTS["mit"].replace("merge", "merge " * 40)]
    docs = documents(spark, extra=extra)
    rows = [r for r in docs.collect() if len(r.text or "") < 50_000]
    docs = spark.createDataFrame([(i, r.text) for i, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs, licenses.build_index(licenses.document_frequencies(docs))).collect()}
    for i, (labels, score) in enumerate(judged([r.text for r in rows])):
        assert got[i].labels == labels and abs(got[i].score - min(score, 1.0)) < 1e-6, (i, labels, score, got[i])
    assert sum(bool(r.labels) for r in got.values()) >= 6


def brute(docs, items, window=10):
    windows = []
    for item, text in items:
        w = tokens(text)
        windows += [(item, w[i : i + window]) for i in range(max(1, len(w) - window + 1))] if w else []
    for d, text in docs:
        w, hit, who = tokens(text), set(), set()
        for item, g in windows:
            for i in range(len(w) - len(g) + 1):
                if w[i : i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    who.add(item)
        yield d, len(w), sorted(hit), sorted(str(x) for x in who if x is not None)


def test_decontamination_against_every_window(spark):
    import random

    rnd = random.Random(9)
    long = words(rnd, 25)
    items = [(1, long), (2, "Short one!"), (3, None), (4, "..."), (5, long), (6, words(rnd, 12)), (10, "größe"), (None, "no id item")]
    extra = [f"before. {long.upper()} after", " ".join(long.split()[3:14]), " ".join(long.split()[:9]), "a SHORT, one short one", "Größe größe", "x no id item y", items[5][1].replace(" ", " -- ")]
    docs = documents(spark, extra=extra)
    benchmark = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, size string")
    want = {}
    for d, n, hit, who in brute([(r.doc_id, r.text) for r in docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()], items):
        want[d] = (n, hit, who)
    for block in (10**6, 300):  # 300: several blocks
        found = decontaminate.scan(docs, benchmark, block_chars=block)
        assert sorted(found.columns) == sorted([*docs.columns, "n_words", "spans", "items"])
        rows = found.collect()
        assert len(rows) == docs.count()
        for r in rows:
            if r.doc_id in want:
                n, hit, who = want[r.doc_id]
                assert (r.n_words, sorted({i for s in r.spans for i in range(s.first_word, s.first_word + s.n_words)}), r["items"]) == (n, hit, who)
                for s in r.spans:
                    assert tokens(r.text[s.begin : s.end]) == tokens(r.text)[s.first_word : s.first_word + s.n_words]
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} & set(want) == {d for d, v in want.items() if not v[1]}
    assert decontaminate.scan(docs, benchmark.filter("false")).filter("size(spans) > 0").count() == 0
    assert decontaminate.scan(empty(spark), benchmark).count() == 0


def test_a_window_of_very_many_items(spark):
    from pyspark.sql import functions as F

    shared, own = " ".join(f"w{i}" for i in range(12)), " ".join(f"v{i}" for i in range(10))
    many = spark.range(100_000).select(F.col("id").cast("string").alias("item_id"), F.when(F.col("id") % 2 == 0, f"{shared} {own}").otherwise(shared).alias("text"))
    patterns, owners = decontaminate.windows_of(many.unionByName(spark.createDataFrame([(None, "nobody knows")], "item_id string, text string")), 10)
    held = {r.pattern: r.owners for r in patterns.collect()}
    assert held["nobody knows"] is None and len(set(held.values())) == 3  # all items, the even ones, no one
    assert all(len(name) < 45 for name in held.values() if name)
    assert owners.groupBy("owners").count().agg(F.sum("count")).first()[0] == 150_000
    docs = spark.createDataFrame([(1, f"x {shared} y"), (2, own), (3, f"{own} {shared}"), (4, "nobody knows"), (5, "clean"), (6, f"x {shared} z"), (7, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in decontaminate.scan(docs, many.unionByName(spark.createDataFrame([(None, "nobody knows")], "item_id string, text string"))).collect()}
    every, even = sorted(map(str, range(100_000))), sorted(map(str, range(0, 100_000, 2)))
    assert [found[i]["items"] == want for i, want in ((1, every), (2, even), (3, every), (4, []), (5, []), (6, every), (7, []))] == [True] * 7
    assert [len(found[i].spans) for i in range(1, 8)] == [1, 1, 1, 1, 0, 1, 0]
    assert {r.doc_id for r in decontaminate.decontaminate(docs, many).collect()} == {4, 5, 7}


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes string")


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 300_000 + "x\r\n\r\nWARC/1.1\r\n"
    rows = [(5, "http://a\r\nX: 1", "same", "c"), (2, None, "same", "c"), (9, "u", "same", "c"), (3, "u", None, "c"), (4, "u", "", "c"), (7, "u", long, "c"), (8, "u", "other", "c"), (8, "u", "other", "c"), (None, "u", "same", "c")]
    frame = pages(spark, rows)
    manifest = warc.write_archives(frame, str(tmp_path / "w"), chunk=1000)
    assert sum(r.n_records for r in manifest.collect()) == len(rows)
    got = warc.read_archives(spark, manifest, chunk=1000).collect()
    last = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got if r.last)
    first = {}
    for p, _, h, _ in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = Counter()
    for p, _, h, _ in rows:
        data = (h or "").encode()
        to = first[h or ""]
        want[(p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if p == to else "revisit", None if p == to else to)] += 1
    assert last == want
    chunks = sorted((r.chunk_no, bytes(r.data), r.payload_bytes) for r in got if r.page_id == 7)
    assert b"".join(c for _, c, _ in chunks) == long.encode() and all(len(c) <= 1000 for _, c, _ in chunks)
    assert [n for _, _, n in chunks] == [min(1000 * (i + 1), len(long.encode())) for i in range(len(chunks))]
    plain = warc.write_archives(frame, str(tmp_path / "p"), least_bytes=5)
    kinds = {r.page_id: r.record_type for r in warc.read_archives(spark, plain, False).collect()}
    assert kinds[5] == kinds[9] == kinds[3] == kinds[4] == "response"  # "same" and empty payloads have fewer bytes than 5
    whole = warc.put_together(warc.read_archives(spark, manifest, chunk=7000)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in whole) == want
    lost = warc.read_archives(spark, manifest, chunk=7000).filter("chunk_no != 3")
    with pytest.raises(Exception, match="chunks are missing"):
        warc.put_together(lost).collect()
    none = warc.write_archives(pages(spark, []), str(tmp_path / "e"))
    assert none.count() == 0 == warc.read_archives(spark, none).count()


def test_the_query_makes_several_chunks_of_a_payload(spark, tmp_path, monkeypatch):
    rows = [(1, "u", "héllo " * 100, "c"), (2, "u", "héllo " * 100, "c"), (3, "u", "short", "c")]
    pages(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    seen = []
    read = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda s, a: seen.append(read(s, a, chunk=64)) or seen[0])
    made = warc.records(pages(spark, rows), chunk=64)
    assert sorted((r.page_id, r["count"]) for r in made.groupBy("page_id").count().collect()) == [(1, 11), (2, 1), (3, 1)]
    got = sorted(tuple(r) for r in warc.op4_warc(spark, str(tmp_path)).collect())
    assert [(g[0], g[1], g[3], g[4]) for g in got] == [(1, 700, "response", None), (2, 700, "revisit", 1), (3, 5, "response", None)]
    assert seen[0].filter("page_id = 1").count() == 11


def test_chunk_tables_carry_digests(spark):
    got = warc.chunk_table(pages(spark, [(1, "u", "abcdefgh", "c"), (2, "u", None, "c")]), chunk=3).orderBy("page_id", "chunk_no").collect()
    assert [(r.page_id, bytes(r.data), r.last) for r in got] == [(1, b"abc", False), (1, b"def", False), (1, b"gh", True), (2, b"", True)]
    assert got[1].sha256 == hashlib.sha256(b"abcdef").hexdigest()


def test_windows_across_runs_of_a_long_text(monkeypatch):
    import uuid
    from types import SimpleNamespace

    import pyarrow as pa

    from barloom.llm import _common

    monkeypatch.setattr(_common, "RUN_BYTES", 15)
    items = [("1", "a b c d e f g h i j k l"), ("2", "Ünï x")]
    texts = ["z " * 30 + "A b-c d e f g h i j k, l " + "z " * 30 + "ünï x", "a b c d e f g h i", "ÜnÏ x ünï X Ünï x", None]
    windows = {}
    for item, text in items:
        w = [x.encode().decode("latin-1") for x in tokens(text)]
        for i in range(max(1, len(w) - 9)):
            windows[" ".join(w[i : i + 10])] = item  # each is of one item: the set's name may be its id
    work = decontaminate._scan(uuid.uuid4().hex, SimpleNamespace(value=list(windows.items())), 10)
    n, spans, who = (c.to_pylist() for c in work(pa.record_batch([pa.array(texts)], names=["text"])))
    for i, (_, total, hit, names) in enumerate(brute(list(enumerate(texts)), items)):
        assert n[i] == total and who[i] == names
        assert sorted(j for s in spans[i] for j in range(s["first_word"], s["first_word"] + s["n_words"])) == hit
        for s in spans[i]:
            assert tokens(texts[i][s["begin"] : s["end"]]) == tokens(texts[i])[s["first_word"] : s["first_word"] + s["n_words"]]
