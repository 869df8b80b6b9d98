import random

import pytest
from pyspark.sql import functions as F

from barloom.config import ValidationRules
from barloom.functions import vectors as V
from barloom.operators import metrics, nearest, quality, sampling, stats


def test_rules(spark):
    good = spark.createDataFrame([(0, 2.0, 1.0, 1.5), (60_000, 2.0, 1.0, 1.5)], "timestamp long, high double, low double, close double")
    assert quality.validate(good, "klines") == (True, [])
    bad = good.unionByName(spark.createDataFrame([(60_000, 1.0, 2.0, -1.0)], good.schema))
    ok, errors = quality.validate(bad, "klines")
    assert not ok and len(errors) == 3
    assert quality.validate(good.filter("false"), "klines") == (False, ["Empty DataFrame"])
    assert not quality.validate(good.select("timestamp"), "depth")[0]
    side = spark.createDataFrame([("BUY", 1.0), ("buy", 0.0), (None, 1.0)], "side string, quantity double")
    assert {r.rule: r.bad_count for r in quality.rule_counts(side, "liquidations").collect()} == {"valid_side": 2, "quantity_gt_zero": 1}
    rate = spark.createDataFrame([(0, None), (28_800_000, 0.1)], "timestamp long, funding_rate double")
    assert len(quality.validate(rate, "funding")[1]) == 2
    assert quality.validate(rate, "funding", ValidationRules(gap_seconds={"funding": 40_000}, modalities={}))[0]


def test_quality_score(spark):
    rows = [("A", i * 60_000, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(3)]
    frame = spark.createDataFrame(rows, "symbol string, timestamp long, open double, high double, low double, close double, volume double, funding_rate double, open_interest double")
    got = quality.quality_report(frame).first()
    assert (got.quality_score, got.funding_rate_coverage, got.gap_count) == (100.0, 1.0, 0)
    twice = quality.quality_report(frame.unionByName(frame.limit(1)).withColumn("close", F.lit(None).cast("double"))).first()
    assert twice.duplicate_rows == 1 and twice.missing_close == 4 and twice.quality_score == 93.0
    assert quality.quality_report(frame.limit(1)).first().largest_gap_ms == 0


def test_statistics(spark):
    frame = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None)], "a double, b double")
    assert [tuple(r) for r in stats.describe(frame).collect()] == [("a", 1.0, 3.0, 2.0, 1.0)]
    four = spark.createDataFrame([(10.0,), (0.0,), (20.0,), (30.0,)], "x double")
    got = stats.robust_fit(four, ["x"]).first()
    assert got.median == 10.0 and got.iqr == 15.0
    assert stats.zscore_fit(spark.createDataFrame([(5.0,), (5.0,)], "x double"), ["x"]).first().std == 1.0
    assert tuple(stats.majority(spark.createDataFrame([(1,), (0,)], "y int")).first()) == (0, 0.5)
    assert tuple(stats.majority(spark.createDataFrame([], "y int")).first()) == (0, 0.0)


def test_normalizer(spark, tmp_path):
    frame = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    with pytest.raises(RuntimeError):
        stats.Normalizer().transform(frame)
    fitted = stats.Normalizer("robust").fit(frame, ["x"])
    fitted.save(tmp_path / "n.json")
    again = stats.Normalizer.load(tmp_path / "n.json")
    assert again.mode == "robust" and [r.x for r in again.transform(frame).collect()] == [r.x for r in fitted.transform(frame).collect()] == [0.0, 2.0]


def test_auc_against_pairs(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(2), float(rnd.randrange(20))) for _ in range(300)]
    pos, neg = ([s for y, s in rows if y == k] for k in (1, 0))
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    frame = spark.createDataFrame(rows, "y int, score double")
    assert abs(metrics.roc_auc(frame).first().auc - want) < 1e-12
    assert metrics.roc_auc(frame.filter("y = 1")).first().auc is None
    assert metrics.roc_auc(frame.filter("false")).first().auc is None


def test_separable_probe_and_clusters(spark):
    rnd = random.Random(2)
    rows = [(i, i % 2, [rnd.gauss(4.0 * (i % 2), 0.3) for _ in range(4)]) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, y int, embedding array<double>")
    assert metrics.probe(frame.filter("vec_id < 150"), frame.filter("vec_id >= 150")).first().balanced_accuracy > 0.95
    found, inertia = metrics.kmeans(frame, 2)
    assert {r.n for r in metrics.cluster_sizes(found).collect()} == {100} and inertia > 0
    assert metrics.silhouette(found).first().silhouette > 0.8
    assert abs(metrics.adjusted_mutual_info(metrics.contingency(found, "y", "cluster")) - 1.0) < 1e-9
    with pytest.raises(ValueError):
        metrics.kmeans(frame.limit(1), 2)


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_neighbours_against_all_pairs(spark, block_rows):
    """Repeated vectors, so that similarities tie; null ids and vectors, and a vector of zeros."""
    import numpy as np

    rnd = np.random.default_rng(3)
    v = np.concatenate([rnd.normal(size=(40, 5)), np.zeros((1, 5))])
    v = np.concatenate([v, v[:19]])
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(None, [1.0] * 5), (99, None)], "vec_id long, embedding array<double>")
    unit = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)
    s = np.round(unit @ unit.T, 12)
    np.fill_diagonal(s, -2)
    want = {(i, k + 1): int(j) for i in range(60) for k, j in enumerate(np.lexsort((np.arange(60), -s[i]))[:3])}
    exact = nearest.neighbours(frame, frame, 3, block_rows=block_rows)
    assert {(r.query, r["rank"]): r.neighbour for r in exact.collect()} == want
    index = nearest.build_index(frame, cells=6)
    assert index.rows.count() == 60
    found = nearest.search(index, frame, 3, probes=2, exact=True, block_rows=block_rows)
    assert {(r.query, r["rank"]): r.neighbour for r in found.collect()} == want
    some = nearest.recall(nearest.search(index, frame, 3, probes=2), exact).first()
    assert some.pairs == 180 and 0.3 < some.recall < 1
    assert nearest.recall(nearest.search(index, frame, 3, probes=6), exact).first().recall == 1
    few = {(r.query, r.neighbour) for r in nearest.search(nearest.build_index(frame.filter("vec_id < 2")), frame.filter("vec_id < 3"), 3, exact=True).collect()}
    assert few == {(0, 1), (1, 0), (2, 0), (2, 1)}


def test_neighbours_make_no_row_for_a_pair(spark):
    frame = spark.range(300).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * i) for i in range(1, 9)]).alias("embedding"))
    plan = nearest.neighbours(frame, frame, 5, block_rows=50)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    empty = frame.filter("vec_id < 0")
    assert nearest.neighbours(empty, frame).count() == nearest.neighbours(frame, empty).count() == nearest.search(nearest.build_index(empty), frame).count() == 0


def test_every_vector_is_asked_for_its_neighbours(spark, tmp_path):
    """No id is divisible by 50, and each vector has its ten nearest of all others all the same. Floats stay floats on their way."""
    from helpers import canonical

    from barloom import queries

    rows = spark.range(1, 41).select((F.col("id") + 100).alias("vec_id"), F.array(*[F.sin(F.col("id") * i).cast("float") for i in range(1, 65)]).alias("embedding"), (F.col("id") % 3).cast("int").alias("label"))
    rows.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [r.asDict() for r in queries.queries()["topk_neighbors"](spark, str(tmp_path)).collect()]
    assert len(got) == 400 and canonical(got) == canonical(of_sql("topk_neighbors", tmp_path))


def test_rates_are_of_every_vector_and_halves_go_upwards(spark, tmp_path):
    """No id is divisible by 50; 1 of 32 is 0.03125, which SQL rounds to 0.0313."""
    from helpers import canonical

    from barloom import queries

    rows = spark.range(1, 41).select((F.col("id") + 100).alias("vec_id"), F.array(*[F.sin(F.col("id") * i).cast("float") for i in range(1, 65)]).alias("embedding"), (F.col("id") % 3).cast("int").alias("label"))
    rows.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [r.asDict() for r in queries.queries()["knn_same_label_rate"](spark, str(tmp_path)).collect()]
    assert got[0]["same_rate"] is not None and canonical(got) == canonical(of_sql("knn_same_label_rate", tmp_path))
    near = spark.range(1, 33).select(F.lit(0).alias("query"), F.col("id").alias("neighbour"))
    labels = spark.range(0, 33).select(F.col("id").alias("vec_id"), (F.col("id") > 1).alias("label"))
    assert tuple(metrics.retrieval_rates(near, labels).first()) == (0.0313, 0.9688)


def of_sql(name, folder):
    import duckdb

    from barloom import queries

    cursor = duckdb.connect().execute(queries.oracle_sql()[name].replace("FROM embeddings", f"FROM '{folder}/embeddings.parquet/*.parquet'"))
    columns = [c[0] for c in cursor.description]
    return [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]


def test_random_pairs_are_of_all_rows_of_a_key(spark):
    frame = spark.range(400).select(F.col("id").alias("vec_id"), (F.col("id") % 3).alias("symbol"), F.array(F.col("id").cast("double")).alias("embedding"))
    rows = metrics.random_pairs(frame, draws=5000).collect()
    assert 1400 < len(rows) < 1900 and all(r.a % 3 == r.b % 3 and r.a != r.b and r.va == [r.a] for r in rows)
    assert len({r.a for r in rows}) > 380 and rows == metrics.random_pairs(frame.repartition(5), draws=5000).collect()


def test_adjusted_mutual_information_against_sums_of_all_counts(spark):
    from math import exp, lgamma, log

    rnd = random.Random(8)
    pairs = [(rnd.randrange(6), rnd.randrange(3)) for _ in range(500)] + [(9, 9)] * 700
    table = metrics.contingency(spark.createDataFrame(pairs, "x int, y int"), "x", "y")
    n, a, b, cells = len(pairs), {}, {}, {}
    for x, y in pairs:
        a[x], b[y], cells[x, y] = a.get(x, 0) + 1, b.get(y, 0) + 1, cells.get((x, y), 0) + 1
    g = lambda k: lgamma(k + 1)
    expected = sum(k / n * log(n * k / (p * q)) * exp(g(p) + g(q) + g(n - p) + g(n - q) - g(n) - g(k) - g(p - k) - g(q - k) - g(n - p - q + k)) for p in a.values() for q in b.values() for k in range(max(1, p + q - n), min(p, q) + 1))
    assert metrics.expected_mutual_information(table) == pytest.approx(expected, abs=1e-9)
    mean = -sum(s / n * log(s / n) for side in (a, b) for s in side.values()) / 2
    mi = sum(k / n * log(n * k / (a[x] * b[y])) for (x, y), k in cells.items())
    assert metrics.adjusted_mutual_info(table) == pytest.approx((mi - expected) / (mean - expected), abs=1e-9)
    assert metrics.adjusted_mutual_info(table.filter("false")) == 1.0


def test_pooling(spark):
    frame = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [True, False]), ([[1.0, 2.0]], [False])], "rows array<array<double>>, mask array<boolean>")
    got = frame.select(V.mean_pooling(F.col("rows"), F.col("mask"), 2).alias("m"), V.attention_pooling(F.col("rows"), F.col("mask"), [0.0, 0.0]).alias("a"), V.flat(F.col("rows")).alias("f")).collect()
    assert got[0].m == [1.0, 2.0] == got[0].a and got[1].m == [0.0, 0.0] == got[1].a and got[0].f == [1.0, 2.0, 3.0, 4.0]


def test_samples_do_not_depend_on_partitions(spark):
    frame = spark.range(100).withColumnRenamed("id", "i")
    a = {r.i for r in sampling.subsample(frame, 10, ["i"]).collect()}
    assert a == {r.i for r in sampling.subsample(frame.repartition(7), 10, ["i"]).collect()} and len(a) == 10
    got = sampling.batches(frame, 8, [F.xxhash64("i"), "i"], drop_last=True)
    assert sorted(r["count"] for r in got.groupBy("batch").count().collect()) == [8] * 12
    masks = frame.select(sampling.random_mask(F.lit(16), 0.25, F.col("i")).alias("m")).collect()
    assert all(sum(r.m) == 5 for r in masks)
