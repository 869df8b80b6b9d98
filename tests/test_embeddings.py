"""Poolings, their cache, reports and the loader's benchmark."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.plans.cache import EmbeddingCache
from barloom.plans.embeddings import pooled_embeddings
from barloom.plans.reports import probe_report, read_reports, retrieval_report, write_reports
from barloom.plans.throughput import benchmark, capped_batches


def summing():
    """An encoder that gives the features themselves, and before them their sum; made here, as executors do not have this module."""
    return lambda features, mask: np.concatenate([features.sum(axis=1, keepdims=True), features], axis=1)


def windows(spark, n=7):
    rows = [(f"s{i}", i, [[float(i), 1.0], [2.0, float(-i)], [None, 3.0]], [i % 3 > 0, i % 2 > 0, False]) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, start_ts long, features array<array<double>>, mask array<boolean>")


def test_all_poolings_come_from_one_run_and_in_order(spark, monkeypatch):
    monkeypatch.setattr("barloom.plans.embeddings.BATCH", 3)
    query = [0.5, -1.0]
    found = pooled_embeddings(windows(spark).coalesce(1), summing(), keep=("symbol", "start_ts"), query=query).collect()
    assert [(r.start_ts, r.pooling) for r in found] == [(i, p) for i in range(7) for p in ("cls", "mean", "attention")]
    for r in found:
        i = r.start_ts
        steps = np.array([[float(i), 1.0], [2.0, float(-i)], [0.0, 3.0]])
        kept = steps[[i % 3 > 0, i % 2 > 0, False]]
        if r.pooling == "cls":
            want = steps.sum(axis=0)
        elif not len(kept):
            want = np.zeros(2)
        else:
            weights = np.ones(len(kept)) if r.pooling == "mean" else np.exp(kept @ query / 2**0.5)
            want = weights @ kept / weights.sum()
        assert np.allclose(r.embedding, want)


def test_unknown_poolings_are_named(spark):
    with pytest.raises(ValueError, match="unknown poolings max, sum"):
        pooled_embeddings(windows(spark), summing(), ["mean", "sum", "max"])
    one = pooled_embeddings(windows(spark), summing(), ["attention", "cls"]).collect()
    assert [r.pooling for r in one[:2]] == ["attention", "cls"] and pooled_embeddings(windows(spark).filter("false"), summing()).count() == 0


def test_cache_computes_what_is_not_held(spark, tmp_path):
    asked = []

    def compute(rows):
        asked.append(sorted(r.id for r in rows.collect()))
        return rows.select("id", (F.col("x") * 2).alias("twice"))

    def frame(*pairs):
        return spark.createDataFrame(list(pairs), "id long, x long")

    cache = EmbeddingCache(spark, str(tmp_path), {"model": 1})
    found, n = cache.through(frame((1, 10), (2, None)), ["id"], ["x"], compute)
    assert n == 2 and sorted((r.id, r.x, r.twice) for r in found.collect()) == [(1, 10, 20), (2, None, None)]
    found, n = cache.through(frame((1, 11), (2, None), (3, 5)), ["id"], ["x"], compute)
    assert n == 2 and {r.id: r.twice for r in found.collect()} == {1: 22, 2: None, 3: 10}
    found, n = EmbeddingCache(spark, str(tmp_path), {"model": 1}).through(frame((1, 10), (3, 5)), ["id"], ["x"], compute)
    assert n == 0 and {r.id: r.twice for r in found.collect()} == {1: 20, 3: 10}
    assert asked == [[1, 2], [1, 3]]
    _, n = EmbeddingCache(spark, str(tmp_path), {"model": 2}).through(frame((1, 10)), ["id"], ["x"], compute)
    assert n == 1 and cache.through(frame(), ["id"], ["x"], compute)[0].count() == 0


def test_cache_keeps_nothing_of_a_run_that_fails(spark, tmp_path):
    def fails(rows):
        return rows.select("id", F.when(F.col("id") == 3, F.raise_error("no")).otherwise(F.col("x")).alias("y"))

    cache = EmbeddingCache(spark, str(tmp_path), {})
    frame = spark.range(8).select("id", F.col("id").alias("x"))
    with pytest.raises(Exception, match="no"):
        cache.through(frame, ["id"], ["x"], fails)
    assert cache.parts() == [] and cache.read() is None
    (tmp_path / "draft").mkdir()
    assert cache.through(frame, ["id"], ["x"], lambda rows: rows.select("id", F.col("x").alias("y")))[1] == 8
    assert len(cache.parts()) == 1 and json.loads(next(tmp_path.glob("*/*.complete.json")).read_text()) == {"rows": 8}


def test_reports_are_one_document_for_each_key(spark, tmp_path):
    rows = spark.createDataFrame([("train", "cls", 1, None), ("test/a", "mean", 2, 0.5)], "split string, pooling string, n long, rate double")
    paths = write_reports(rows, str(tmp_path), "probe")
    assert [p.rsplit("/", 1)[1] for p in paths] == ["probe_test-a_mean.json", "probe_train_cls.json"]
    assert json.loads((tmp_path / "probe_train_cls.json").read_text()) == {"split": "train", "pooling": "cls", "n": 1, "rate": None}
    write_reports(rows.withColumn("n", F.col("n") + 1), str(tmp_path), "probe")
    got = read_reports(spark, str(tmp_path), "probe", "split string, pooling string, n long, rate double")
    assert sorted((r.split, r.n, r.rate) for r in got.collect()) == [("test/a", 3, 0.5), ("train", 2, None)]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["probe_test-a_mean.json", "probe_train_cls.json"]
    with pytest.raises(ValueError, match="train_cls"):
        write_reports(rows.unionByName(rows.limit(1)), str(tmp_path), "probe")


def test_retrieval_of_each_key_stays_within_it(spark):
    rows = [(i, f"k{i % 2}", "mean", "near" if i % 4 < 2 else "far", [1.0, 0.01 * i] if i % 4 < 2 else [0.01 * i, 1.0]) for i in range(24)] + [(99, "few", "mean", "x", [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, split string, pooling string, symbol string, embedding array<double>")
    found = {r.split: r for r in retrieval_report(frame, 3).collect()}
    assert all((found[k].n_samples, found[k].same_rate, found[k].valid) == (12, 1.0, True) for k in ("k0", "k1"))
    assert (found["few"].valid, found["few"].same_rate, found["few"].n_samples) == (False, None, 1)


def test_probe_of_each_pooling(spark):
    rows = [(i, p, i % 2, [float(i % 2) * (1 if p == "cls" else 0) + 0.01 * (i % 5), 1.0]) for i in range(80) for p in ("cls", "mean")]
    frame = spark.createDataFrame(rows, "vec_id long, pooling string, up int, embedding array<double>")
    found = {r.pooling: r for r in probe_report(frame.filter("vec_id < 60"), frame.filter("vec_id >= 60"), frame.filter("vec_id < 20"), ("up",)).collect()}
    assert (found["cls"].cross_symbol, found["cls"].in_sample, found["cls"].majority, found["cls"].task) == (1.0, 1.0, 0.5, "up")
    assert found["mean"].cross_symbol < 0.8


def test_batches_are_capped_within_tasks(spark):
    rows = spark.range(0, 1000, 1, 4)
    assert sorted(r.n for r in capped_batches(rows, 100).collect()) == [50] * 4 + [100] * 8
    for most in (0, 1, 3, 7):
        assert [r.n for r in capped_batches(rows, 100, most).collect()] == [100] * most
    assert sum(r.n for r in capped_batches(rows, 100, 1000).collect()) == 1000
    found = benchmark(rows, 5, 100, 6)
    assert (found["batches"], found["samples"], found["bytes"]) == (6, 600, 12_000) and found["samples_per_sec"] > 0
    assert set(benchmark(rows.filter("id < 0"), 5).values()) == {0}


def test_rows_are_sent_as_often_in_larger_tables(spark):
    from barloom.operators.nearest import BLOCK_ROWS, MOST_BLOCKS, parts_of

    parts = [r.p for r in spark.createDataFrame([(n,) for n in (0, 1, BLOCK_ROWS, 10_000, 100_000, 500_000, 5_000_000)], "n long").select(parts_of(F.col("n"), BLOCK_ROWS).alias("p")).collect()]
    assert parts[:6] == [0, 1, 1, 8, 8, 8] and parts[6] == -(-5_000_000 // (BLOCK_ROWS * MOST_BLOCKS))


def random_vectors(spark, folder, n, seed=3):
    rnd = np.random.default_rng(seed)
    rows = [(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(rnd.integers(0, 4, n), rnd.standard_normal((n, 64)), strict=True))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return np.array([r[2] for r in rows], np.float32).astype(float), np.array([r[1] for r in rows])


def test_cells_met_first_are_enough_in_a_larger_table(spark, tmp_path):
    from barloom import queries

    random_vectors(spark, tmp_path, 9_000)
    row = queries.index_recall(spark, str(tmp_path)).first()
    assert (row.pairs, row.enough) == (1_800, True)


def test_silhouettes_are_of_all_rows(spark, tmp_path):
    """More rows than any sample of the measure had, copies among them."""
    from barloom import queries

    v, c = random_vectors(spark, tmp_path, 8_200)
    v[8_000:], c[8_000:] = v[0], 7
    spark.createDataFrame([(i, int(c[i]), v[i].tolist()) for i in range(len(v))], "vec_id long, label int, embedding array<float>").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    xx = (v**2).sum(axis=1)
    d = np.sqrt(np.maximum(xx[:, None] + xx - 2 * v @ v.T, 0))
    d[8_000:, 8_000:] = 0
    sums = np.stack([d[:, c == k].sum(axis=1) for k in (0, 1, 2, 3, 7)], axis=1)
    n = np.array([(c == k).sum() for k in (0, 1, 2, 3, 7)])
    own = np.searchsorted([0, 1, 2, 3, 7], c)
    a = sums[np.arange(len(v)), own] / (n[own] - 1)
    other = sums / n
    other[np.arange(len(v)), own] = np.inf
    b = other.min(axis=1)
    want = ((b - a) / np.maximum(a, b)).mean()
    assert queries.label_silhouette(spark, str(tmp_path)).first().silhouette == pytest.approx(want, abs=2e-6)


def test_silhouettes_of_odd_rows(spark):
    from barloom.operators import metrics

    def of(*rows):
        return metrics.silhouette(spark.createDataFrame(list(rows), "vec_id long, cluster int, embedding array<double>")).first().silhouette

    assert of() is None and of((1, 0, [1.0])) is None
    assert of((1, 0, [1.0]), (2, 1, [1.0]), (3, 1, [1.0])) == 0.0  # all at one place
    assert of((1, 0, [0.0]), (2, 0, [0.0]), (3, 1, [2.0]), (4, None, [9.0]), (5, 1, None)) == pytest.approx(2 / 5)


def test_kmeans_silhouette_takes_all_rows(spark, tmp_path):
    from barloom import queries
    from barloom.operators import metrics

    random_vectors(spark, tmp_path, 8_100)
    seen, real = [], metrics.silhouette
    found, _ = metrics.kmeans(spark.read.parquet(f"{tmp_path}/embeddings.parquet"))
    for rows in (None, 8_000):
        seen.append(real(found, rows=rows).first().silhouette)
    assert queries.kmeans_silhouette(spark, str(tmp_path)).first().silhouette == pytest.approx(seen[0], abs=1e-9) != seen[1]
