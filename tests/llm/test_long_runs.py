import random

import numpy as np
import pyarrow as pa
from test_learned import speech

from barloom.llm import langid


def test_all_letters_of_a_long_mixed_run_are_labelled():
    rnd = random.Random(6)
    chain = langid.fit_chain([(lang, speech(rnd, lang, 40)) for _ in range(40) for lang in ("en", "fr")])
    run = speech(rnd, "en", 60).replace(" ", "")[:100] + speech(rnd, "fr", 4000).replace(" ", "")[:4900]
    labels = langid.word_labels(run, chain)
    assert "".join(w for w, _, _ in labels) == run
    assert labels[0][1] == "en" and {lang for _, lang, _ in labels[3:]} == {"fr"}
    both = langid.word_labels(f"th er {run[:60]}", chain)
    assert [w for w, _, _ in both] == ["th", "er", run[:60]]  # a word of 60 letters is one


def test_words_that_share_forty_letters_differ_in_features():
    head = "er" * 20
    owner, bucket = langid.features([f"{head}theron", f"{head}", f"{head}anaian"], {})
    own = [set(bucket[owner == i].tolist()) for i in range(3)]
    assert own[0] != own[1] and own[0] != own[2]
    alone = langid.features([f"{head}theron"], {})
    assert sorted(bucket[owner == 0].tolist()) == sorted(alone[1].tolist())
    assert len(langid.features([], {})[0]) == 0 and np.all(alone[0] == 0)


def test_a_chain_is_carried_across_runs(monkeypatch):
    rnd, numbers = random.Random(1), np.random.default_rng(2)
    k = 3
    chain = langid.Chain(["de", "en", "fr"], numbers.normal(size=(1 << langid.BITS, k)), numbers.normal(size=k), numbers.normal(size=(k, k)), {})
    text = " ".join(speech(rnd, lang, 45) for lang in rnd.choices(["en", "fr", "de"], k=12))
    whole = langid.word_labels(text, chain)
    sums, counts = langid._Labeller(chain).means(pa.array([text, "th", text]))
    monkeypatch.setattr(langid, "RUN", 3 * langid.STEPS)  # 540 words are three runs, the last one partial
    assert len(list(langid.word_runs(text))) == 3
    parts = langid.word_labels(text, chain)
    assert [p[:2] for p in parts] == [w[:2] for w in whole]
    assert np.allclose([p[2] for p in parts], [w[2] for w in whole], atol=1e-12) and min(w[2] for w in whole) < 0.6
    again, number = langid._Labeller(chain).means(pa.array([text, "th", text]))
    assert np.allclose(again, sums) and list(number) == list(counts) == [540, 1, 540]


def test_words_are_found_before_they_are_lowered(monkeypatch):
    text = "İstanbul ΟΔΟΣ ½ x½y ⅷ ² ٣ a_b " + "Ä" * 200
    short = [w for run in langid.word_runs(text) for w in run]
    monkeypatch.setattr(langid, "RUN", 2)
    assert [w for run in langid.word_runs(text) for w in run] == short
    assert short == ["i̇stanbul", "οδος", "x", "y", "a", "b", "ä" * 100, "ä" * 100]


def test_numerals_are_no_letters(spark):
    rnd = random.Random(6)
    chain = langid.fit_chain([(lang, speech(rnd, lang, 40)) for _ in range(10) for lang in ("en", "fr")])
    docs = spark.createDataFrame([(1, "½ ² ⅷ"), (2, "数")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, chain).collect()}
    assert got[1] == "und" and got[2] != "und"


def test_the_sample_is_bounded_with_repeated_ids(spark, monkeypatch):
    rnd = random.Random(7)
    rows = [(None if i % 2 else 3, speech(rnd, "en", 5), f"l{i % 30}") for i in range(600)]
    seen = []
    monkeypatch.setattr(langid, "fit_chain", seen.append)
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), texts=10, most=25)
    assert len(seen[0]) == 25
