"""Evaluation: classification metrics, neighbours, temporal consistency, clustering, baselines and probes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, distance, dot, doubles, norm
from ..storage import durable
from .ranks import numbered, ranged
from .stats import threshold_values
from .windows import with_next


def accuracy(frame: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return frame.agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def balanced_accuracy(frame: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """The mean, over the classes of y, of the share of their rows that are predicted."""
    return frame.groupBy(y).agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("recall")).agg(F.avg("recall").alias("balanced_accuracy"))


def roc_auc(frame: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """One row, auc: the chance that a positive's score exceeds a negative's, ties counting half; null without both classes.

    Rows are first counted by score, so ranks run over distinct scores, in slots of their range: no window holds them all.
    """
    counts = frame.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum((F.col(y) == 1).cast("long")).alias("p"), F.sum((F.col(y) != 1).cast("long")).alias("n"))
    rows = ranged(counts, "s", slot="slot")
    ahead = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = rows.groupBy("slot").agg(F.sum("n").alias("n")).select("slot", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("slot").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = rows.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(slots, "slot")
    won = F.sum(F.col("p") * (F.col("before") + F.col("inside") + F.col("n") / 2.0))
    return below.agg(F.try_divide(won, F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def persistence(frame: DataFrame, last_return: str = "last_return") -> Column:
    """The prediction that the last move goes on."""
    return (F.col(last_return) > 0).cast("int")


def evaluate_task(frame: DataFrame, label: str, majority_class: int, with_persistence: bool) -> DataFrame:
    """(baseline, balanced_accuracy) of the majority and, for future returns, the persistence baseline."""
    preds = {"majority": F.lit(majority_class)} | ({"persistence": persistence(frame)} if with_persistence else {})
    rows = frame.select(F.col(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(k).alias("baseline"), v.cast("int").alias("pred")) for k, v in preds.items()])).alias("b")).select("y", "b.*")
    recall = rows.groupBy("baseline", "y").agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("recall"))
    return recall.groupBy("baseline").agg(F.avg("recall").alias("balanced_accuracy"))


def retrieval_rates(near: DataFrame, labels: DataFrame, vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """One row: the shares of neighbours with the query's label and with another, to 4 places, halves upwards."""
    a = labels.select(F.col(vec_id).alias("query"), F.col(label).alias("own"))
    b = labels.select(F.col(vec_id).alias("neighbour"), F.col(label).alias("theirs"))
    same = F.avg((F.col("own") == F.col("theirs")).cast("double"))
    return near.join(a, "query").join(b, "neighbour").agg(*[(F.floor(x * 10_000 + 0.5) / 10_000).alias(name) for name, x in (("same_rate", same), ("cross_rate", 1 - same))])


def adjacent_cosines(frame: DataFrame, order: list[str], key: str = "symbol", vector: str = "embedding", mode: str = "global") -> DataFrame:
    """(key, order columns, cosine) of each row and its next one, where both have one key: next in the order of all rows, or
    (per_symbol) in the order of the key's own."""
    if mode == "per_symbol":
        w = Window.partitionBy(key).orderBy(*order)
        rows = frame.withColumn(f"next_{vector}", F.lead(vector).over(w)).withColumn(f"next_{key}", F.lead(key).over(w))
    else:
        rows = with_next(frame, order, [vector, key])
    return rows.filter(F.col(f"next_{key}") == F.col(key)).select(key, *[c for c in order if c != key], cosine(F.col(vector), F.col(f"next_{vector}")).alias("cosine"))


#: Random pairs wanted for each row and in all, and draws for them.
PAIRS_EACH, MOST_PAIRS, DRAWS = 10, 10_000, 100_000


def drawn(n: int, draw: Column, side: str, seed: int) -> Column:
    """A number below `n` from the md5 of seed, draw and side, so that any engine draws alike."""
    text = F.concat(F.lit(f"{seed}:"), draw.cast("string"), F.lit(f":{side}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % n


def random_pairs(frame: DataFrame, key: str = "symbol", vec_id: str = "vec_id", vector: str = "embedding", seed: int = 0, draws: int = DRAWS) -> DataFrame:
    """(draw, a, b, va, vb): ids and vectors of pairs of different rows of one key. Both rows of each of `draws` draws are any of all
    rows; those of two keys, or twice one row, are passed over, and of the others the first PAIRS_EACH for each row, MOST_PAIRS
    in all, are kept.

    Rows are numbered in the order of vec_id, in slots; the drawn numbers, twice `draws` at most, are looked up by a broadcast.
    """
    rows = durable(numbered(frame.select(F.col(key).alias("key"), F.col(vec_id).alias("id"), F.col(vector).alias("v")), "id"))
    n = rows.count()
    made = frame.sparkSession.range(draws).withColumnRenamed("id", "draw")
    made = made.select("draw", drawn(n, F.col("draw"), "a", seed).alias("ia"), drawn(n, F.col("draw"), "b", seed).alias("ib")).filter("ia != ib")
    wanted = made.select(F.explode(F.array("ia", "ib")).alias("_n")).distinct()
    own = durable(rows.join(F.broadcast(wanted), "_n"))
    a, b = (own.select(F.col("_n").alias(f"i{x}"), F.col("id").alias(x), F.col("v").alias(f"v{x}"), F.col("key").alias(f"k{x}")) for x in "ab")
    same = made.join(a, "ia").join(b, "ib").filter("ka = kb")
    return same.orderBy("draw").limit(min(MOST_PAIRS, PAIRS_EACH * n)).select("draw", "a", "b", "va", "vb")


def temporal_consistency(frame: DataFrame, order: list[str], key: str = "symbol", vector: str = "embedding", vec_id: str = "vec_id", seed: int = 0, least_rows: int = 100) -> DataFrame:
    """One row: adjacent and random mean cosine, the adjacent ones' population deviation, and the AUC that separates them (0.5
    if either side is missing). Fewer than `least_rows` rows are a ValueError."""
    if (n := frame.count()) < least_rows:
        raise ValueError(f"{n} rows, {least_rows} needed")
    near = adjacent_cosines(frame, order, key, vector).select("cosine", F.lit(1).alias("y"))
    far = random_pairs(frame, key, vec_id, vector, seed).select(cosine(F.col("va"), F.col("vb")).alias("cosine"), F.lit(0).alias("y"))
    both = durable(near.unionByName(far))
    auc = roc_auc(both, "y", "cosine").first().auc
    of = {y: F.when(F.col("y") == y, F.col("cosine")) for y in (0, 1)}
    return both.agg(F.avg(of[1]).alias("adjacent_mean"), F.stddev_pop(of[1]).alias("adjacent_std"), F.avg(of[0]).alias("random_mean"), F.lit(0.5 if auc is None else auc).alias("separation_auc"))


def norm_regime(frame: DataFrame, vector: str = "embedding") -> DataFrame:
    """`frame` with norm, and regime: whether it is at or above the median norm."""
    rows = frame.withColumn("norm", norm(F.col(vector)))
    limit = threshold_values(rows, ["norm"])["norm"]
    return rows.withColumn("regime", (F.col("norm") >= F.lit(limit).cast("double")).cast("int"))


def contingency(frame: DataFrame, a: str, b: str) -> DataFrame:
    return frame.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def mutual_information(table: DataFrame) -> DataFrame:
    """One row: mi and both entropies (nats), h_a and h_b, of a contingency table (a, b, n)."""
    sums = table.groupBy("a").agg(F.sum("n").alias("s")).select(F.lit("a").alias("of"), "s")
    sums = sums.unionByName(table.groupBy("b").agg(F.sum("n").alias("s")).select(F.lit("b").alias("of"), "s")).unionByName(table.select(F.lit("ab").alias("of"), F.col("n").alias("s")))
    entropies = sums.groupBy("of").agg((F.log(F.sum("s")) - F.sum(F.col("s") * F.log("s")) / F.sum("s")).alias("h"))
    both = entropies.agg(*[F.max(F.when(F.col("of") == of, F.col("h"))).alias(f"h_{of}") for of in ("a", "b", "ab")])
    return both.select((F.col("h_a") + F.col("h_b") - F.col("h_ab")).alias("mi"), "h_a", "h_b")


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of numbers of 1 and more: Stirling's series eight places on, to some 1e-12."""
    y, shift = x + 8, x
    for i in range(1, 8):
        shift = shift * (x + i)
    return (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - F.log(shift)


#: Different sums of rows or columns of a contingency table: they come to the driver.
MOST_SUMS = 10_000
#: Counts that are tried at once for two sums.
COUNTS = 10_000


def expected_mutual_information(table: DataFrame) -> float:
    """The mean mutual information (nats) of contingency tables with the row and column sums of `table` (a, b, n).

    Equal sums are worked out once. Each pair of sums is rows of COUNTS possible counts; those beyond 40 and a dozen deviations from the
    mean, which have no weight that a double could show, are not tried.
    """
    sums = {}
    for of in ("a", "b"):
        per = table.groupBy(of).agg(F.sum("n").cast("double").alias("s")).groupBy("s").agg(F.count("*").alias("k"))
        sums[of] = per.limit(MOST_SUMS + 1).collect()
        if len(sums[of]) > MOST_SUMS:
            raise ValueError(f"more than {MOST_SUMS} different sums")
    total = sum(r.s * r.k for r in sums["a"])
    a, b = (F.from_json(F.lit(json.dumps([{"s": r.s, "k": r.k} for r in sums[of]])), "array<struct<s:double,k:long>>") for of in ("a", "b"))
    n = F.lit(float(total))
    rows = table.sparkSession.range(1).select(F.explode(a).alias("a")).repartition(max(1, min(len(sums["a"]), 200))).select("a", F.explode(b).alias("b"))
    rows = rows.select(F.col("a.s").alias("a"), F.col("b.s").alias("b"), (F.col("a.k") * F.col("b.k")).alias("k"))
    mean = F.col("a") * F.col("b") / n
    around = 40 + 12 * F.sqrt(mean * (1 - F.col("a") / n) * (1 - F.col("b") / n))
    rows = rows.withColumns({"low": F.ceil(F.greatest(F.lit(1.0), F.col("a") + F.col("b") - n, mean - around)), "high": F.floor(F.least("a", "b", mean + around))}).filter("low <= high")
    rows = rows.withColumn("from", F.explode(F.sequence("low", "high", F.lit(COUNTS).cast("long"))))
    rows = rows.withColumn("n", F.explode(F.sequence("from", F.least(F.col("from") + COUNTS - 1, "high"))))
    x = F.col("n").cast("double")
    chance = F.exp(log_gamma(F.col("a") + 1) + log_gamma(F.col("b") + 1) + log_gamma(n - F.col("a") + 1) + log_gamma(n - F.col("b") + 1) - log_gamma(n + 1) - log_gamma(x + 1) - log_gamma(F.col("a") - x + 1) - log_gamma(F.col("b") - x + 1) - log_gamma(n - F.col("a") - F.col("b") + x + 1))
    return rows.agg(F.sum(F.col("k") * x / n * F.log(n * x / (F.col("a") * F.col("b"))) * chance)).first()[0] or 0.0


def adjusted_mutual_info(table: DataFrame) -> float:
    """AMI, with the arithmetic mean of entropies, of a contingency table (a, b, n). 1 of no rows, of one class on both sides, and of
    classes that are all single rows."""
    table = durable(table)
    total, cells, rows, columns = table.agg(F.sum("n"), F.count("*"), F.countDistinct("a"), F.countDistinct("b")).first()
    if not total or rows == columns == 1 or rows == columns == total:
        return 1.0
    held = mutual_information(table).first()
    expected, mean = expected_mutual_information(table), (held.h_a + held.h_b) / 2
    return (held.mi - expected) / (mean - expected) if mean != expected else 1.0


def _distances(left, right):
    """For two blocks of rows (id, c, v) and (id2, c2, v2): the sum and number of distances of each left row to the rows of each cluster on
    the right, itself left out. Distances are roots of products; those of near copies, which products cannot tell, are of differences."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    from .nearest import PRODUCTS

    right = right.sort_by("c2")
    if not len(left) or not len(right):
        return pa.table({"id": left["id"].slice(0, 0), "c": left["c"].slice(0, 0), "c2": right["c2"].slice(0, 0), "d": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
    x, y = (np.asarray(t[c].combine_chunks().flatten(), np.float64).reshape(len(t), -1) for t, c in ((left, "v"), (right, "v2")))
    xx, yy = (np.einsum("ij,ij->i", z, z) for z in (x, y))
    clusters = right["c2"].to_pandas()
    first = np.flatnonzero((clusters != clusters.shift()).to_numpy())
    own = pd.DataFrame({"id": left["id"].to_pandas()}).rename_axis("i").reset_index().merge(pd.DataFrame({"id": right["id2"].to_pandas()}).rename_axis("j").reset_index(), "inner", "id").sort_values("i")
    i, j = own["i"].to_numpy(), own["j"].to_numpy()
    sums, step = np.empty((len(x), len(first))), max(1, PRODUCTS // len(y))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        both = xx[at : at + step, None] + yy
        d = both - 2 * (part @ y.T)
        row, col = np.nonzero(d <= 1e-6 * both)
        for some in range(0, len(row), 65_536):
            r, c = row[some : some + 65_536], col[some : some + 65_536]
            d[r, c] = ((part[r] - y[c]) ** 2).sum(axis=1)
        d = np.sqrt(d, out=d)
        same = slice(*np.searchsorted(i, [at, at + len(part)]))
        d[i[same] - at, j[same]] = 0
        sums[at : at + step] = np.add.reduceat(d, first, axis=1)
    n = np.tile(np.diff(np.append(first, len(y))), (len(x), 1))
    np.subtract.at(n, (i, np.searchsorted(first, j, side="right") - 1), 1)
    row, col = np.nonzero(n)
    return pa.table({"id": left["id"].take(pa.array(row)), "c": left["c"].take(pa.array(row)), "c2": right["c2"].take(pa.array(first[col])), "d": pa.array(sums[row, col]), "n": pa.array(n[row, col])})


def silhouette(frame: DataFrame, cluster: str = "cluster", vector: str = "embedding", vec_id: str = "vec_id", rows: int | None = None, seed: int = 0) -> DataFrame:
    """One row: the mean Euclidean silhouette, singletons counting 0; of a seeded sample of `rows` rows if that is given, else of all.

    Every row meets every row, in the blocks of `nearest`, out of which come sums for each row and cluster and no row for each pair.
    Rows without an id take no part; those without a cluster or a vector count 0.
    """
    from .nearest import BLOCK_ROWS, parts_of

    if rows is not None:
        frame = frame.orderBy(F.xxhash64(F.lit(seed), vec_id), vec_id).limit(rows)
    held = durable(frame.select(F.col(vec_id).alias("id"), F.col(cluster).alias("c"), doubles(F.col(vector)).alias("v")).filter("id IS NOT NULL"))
    whole = held.filter(F.col("c").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    ids, n, sides = held.agg(F.count_distinct("id"), F.count("*"), parts_of(F.count("*"), BLOCK_ROWS)).first()
    part, every = F.pmod(F.xxhash64("id"), F.lit(sides)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sides - 1)))
    left = whole.withColumn("qp", part).withColumn("bp", every)
    right = whole.withColumn("bp", part).withColumn("qp", every).toDF("id2", "c2", "v2", "bp", "qp")
    kinds = {f.name: f.dataType.simpleString() for f in whole.schema}
    sums = left.groupBy("qp", "bp").cogroup(right.groupBy("qp", "bp")).applyInArrow(_distances, f"id {kinds['id']}, c {kinds['c']}, c2 {kinds['c']}, d double, n long")
    mean = sums.groupBy("id", "c", "c2").agg((F.sum("d") / F.sum("n")).alias("d"))
    ab = mean.groupBy("id").agg(F.min(F.when(F.col("c") == F.col("c2"), F.col("d"))).alias("a"), F.min(F.when(F.col("c") != F.col("c2"), F.col("d"))).alias("b"))
    one = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return ab.agg((F.sum(one) / F.lit(ids if ids > 1 else None).cast("double")).alias("silhouette"))


def _vectors(frame: DataFrame, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return frame.withColumn("_x", array_to_vector(doubles(F.col(vector))))


def kmeans(frame: DataFrame, k: int = 8, vector: str = "embedding", seed: int = 42):
    """(`frame` with cluster, inertia). Fewer rows than k are a ValueError."""
    from pyspark.ml.clustering import KMeans

    if frame.limit(k).count() < k:
        raise ValueError(f"fewer than {k} rows")
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(_vectors(frame, vector))
    return model.transform(_vectors(frame, vector)).drop("_x"), model.summary.trainingCost


def cluster_sizes(frame: DataFrame, cluster: str = "cluster") -> DataFrame:
    return frame.groupBy(cluster).agg(F.count("*").alias("n"))


def pca(frame: DataFrame, dims: int = 2, vector: str = "embedding") -> DataFrame:
    """`frame` with pca, an array of `dims` components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    rows = _vectors(frame, vector)
    return PCA(k=dims, inputCol="_x", outputCol="_p").fit(rows).transform(rows).withColumn("pca", vector_to_array("_p")).drop("_x", "_p")


def _constant(values: list[float]) -> Column:
    """A constant array; as JSON it is one literal in the plan, however long."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def scaling(fit: DataFrame, vector: str = "embedding") -> tuple[list[float], list[float]]:
    """Means and population deviations (1 where 0) of each place of the vectors: as many numbers as a vector has."""
    places = fit.select(F.posexplode(doubles(F.col(vector))).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
    return [r.m for r in places], [r.s or 1.0 for r in places]


def logistic(fit: DataFrame, frame: DataFrame, label: str = "y", vector: str = "embedding", c: float = 1.0, scale: bool = True, rounds: int = 100) -> DataFrame:
    """`frame` with pred and p1 of a ridge logistic regression of inverse strength `c` on `fit`, standardised if asked. One class
    in `fit` gives that class. The fitted weights become an expression: scoring needs no join and no model."""
    from pyspark.ml.classification import LogisticRegression

    n, classes, only = fit.agg(F.count("*"), F.countDistinct(label), F.min(label)).first()
    if classes < 2:
        return frame.withColumn("pred", F.lit(only)).withColumn("p1", F.lit(None if only is None else float(only)))
    mean, deviation = scaling(fit, vector) if scale else ([], [])
    x = doubles(F.col(vector))
    if scale:
        x = F.zip_with(F.zip_with(x, _constant(mean), lambda v, m: v - m), _constant(deviation), lambda v, s: v / s)
    # Every step of the fit is a job: as few partitions as the rows need.
    rows = _vectors(fit.select(x.alias(vector), F.col(label).cast("double").alias("_y")), vector).select("_x", "_y").coalesce(max(1, n // 20_000))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=rounds, tol=1e-5).fit(rows)
    weights, bias = model.coefficients.toArray().tolist(), float(model.intercept)
    if scale:
        bias -= sum(w * m / s for w, m, s in zip(weights, mean, deviation, strict=True))
        weights = [w / s for w, s in zip(weights, deviation, strict=True)]
    p1 = 1 / (1 + F.exp(-(F.lit(bias) + dot(F.col(vector), _constant(weights)))))
    return frame.withColumn("p1", p1).withColumn("pred", (F.col("p1") > 0.5).cast("int"))


def probe(fit: DataFrame, frame: DataFrame, label: str = "y", vector: str = "embedding") -> DataFrame:
    """One row: balanced accuracy and accuracy of an unscaled linear probe, and the accuracy of the fit rows' majority class."""
    from .stats import majority

    top = majority(fit, label).first()["majority"]
    hit = (F.col(label) == F.col("pred")).cast("long")
    by_class = logistic(fit, frame, label, vector, scale=False).groupBy(label).agg(F.sum(hit).alias("hits"), F.count("*").alias("n"))
    n = F.sum("n")
    return by_class.agg(F.avg(F.col("hits") / F.col("n")).alias("balanced_accuracy"), (F.sum("hits") / n).alias("accuracy"), (F.sum(F.when(F.col(label) == top, F.col("n")).otherwise(0)) / n).alias("majority_accuracy"))


def masked_loss(frame: DataFrame, loss: str = "loss", mask: str = "mask", keys: list[str] | None = None) -> DataFrame:
    """Sum of loss where masked over the number of masked places (1 at least), of array columns, by `keys`."""
    kept = F.aggregate(F.zip_with(F.col(loss), F.col(mask), lambda x, m: F.when(m, x.cast("double")).otherwise(0.0)), F.lit(0.0), lambda acc, x: acc + x)
    n = F.size(F.filter(F.col(mask), lambda m: m))
    rows = frame.select(*(keys or []), kept.alias("_l"), n.alias("_n"))
    return (rows.groupBy(*keys) if keys else rows).agg((F.sum("_l") / F.greatest(F.sum("_n"), F.lit(1))).alias("mean_loss"))
