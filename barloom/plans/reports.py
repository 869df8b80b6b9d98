"""Reports: one JSON document for each key, whole or not there."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, nearest
from ..storage import durable
from .files import at_path, swap

KEYS = ("split", "pooling")


def write_reports(reports: DataFrame, folder: str, name: str, keys: tuple[str, ...] = KEYS) -> list[str]:
    """Writes each row of `reports` (keys and any results) as <folder>/<name>_<key>_<key>.json, and gives the paths.

    Tasks write the documents under a draft folder through Spark's committer, so one that is run again leaves no second copy;
    then each file gets its name. A row for each combination of keys; two of one combination are a ValueError.
    """
    spark, folder = reports.sparkSession, folder.rstrip("/")
    made = [c for c in reports.columns if c not in keys]
    document = F.to_json(F.struct(*[F.col(c) for c in (*keys, *made)]), {"ignoreNullFields": "false", "pretty": "true"})
    label = F.concat_ws("_", *[F.regexp_replace(F.col(k).cast("string"), r"[^\w.-]", "-") for k in keys])
    rows = durable(reports.select(label.alias("label"), document.alias("value")))
    if again := [r.label for r in rows.groupBy("label").count().filter("count > 1").collect()]:
        raise ValueError(f"more than one report of {', '.join(sorted(again))}")
    draft = f"{folder}/_draft-{uuid.uuid4().hex}"
    rows.repartition("label").write.partitionBy("label").text(draft)
    paths = []
    for label in sorted(r.label for r in rows.select("label").collect()):  # a file for each key
        fs, at = at_path(spark, f"{draft}/label={label}/part-*")
        path = f"{folder}/{name}_{label}.json"
        swap(spark, fs, fs.globStatus(at)[0].getPath(), path)
        paths.append(path)
    fs, at = at_path(spark, draft)
    fs.delete(at, True)
    return paths


def read_reports(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The reports of a name, one row for each file."""
    return spark.read.schema(schema).option("multiLine", "true").json(f"{folder.rstrip('/')}/{name}_*.json")


def retrieval_report(embeddings: DataFrame, k: int = 10, keys: tuple[str, ...] = KEYS, vec_id: str = "vec_id", label: str = "symbol", vector: str = "embedding") -> DataFrame:
    """For each key: k, n_samples, and, to 4 places, the shares of the k nearest of every row that have its label (same_rate) and
    another (cross_rate); valid says whether there are more than k rows. All keys in one pass."""
    sizes = embeddings.groupBy(*keys).agg(F.count("*").alias("n_samples"))
    near = nearest.neighbours(embeddings, embeddings, k, vec_id, vector, keys)
    own, other = (embeddings.select(*keys, F.col(vec_id).alias(x), F.col(label).alias(f"{x}_label")) for x in ("query", "neighbour"))
    same = F.avg((F.col("query_label") == F.col("neighbour_label")).cast("double"))
    rates = near.join(own, [*keys, "query"]).join(other, [*keys, "neighbour"]).groupBy(*keys).agg(F.bround(same, 4).alias("same_rate"), F.bround(1 - same, 4).alias("cross_rate"))
    valid = F.col("n_samples") > k

    def told(c: str) -> Column:
        return F.when(valid, F.col(c)).alias(c)

    return sizes.join(rates, list(keys), "left").select(*keys, F.lit(k).cast("long").alias("k"), "n_samples", told("same_rate"), told("cross_rate"), valid.alias("valid"))


def probe_report(fit: DataFrame, cross: DataFrame, in_sample: DataFrame, tasks: tuple[str, ...], keys: tuple[str, ...] = ("pooling",), vector: str = "embedding") -> DataFrame:
    """For each key and task (a column of 0 and 1): balanced accuracy of an unscaled linear probe fitted on `fit`, on rows of other
    symbols (cross_symbol) and of the fit's own (in_sample), and the accuracy of the fit's majority class, to 4 places.

    A fit for each key and task, so keys must be few: they come to the driver.
    """
    found = None
    for own in fit.select(*keys).distinct().orderBy(*keys).collect():
        a, b, c = (durable(x.filter(" AND ".join(f"`{k}` = '{own[k]}'" for k in keys))) for x in (fit, cross, in_sample))
        for task in tasks:
            y = [x.withColumn("y", F.col(task)) for x in (a, b, c)]
            of = metrics.probe(y[0], y[1].select("y", vector), vector=vector).first()
            inside = metrics.probe(y[0], y[2].select("y", vector), vector=vector).first()
            row = fit.sparkSession.range(1).select(*[F.lit(own[k]).alias(k) for k in keys], F.lit(task).alias("task"), F.round(F.lit(of.balanced_accuracy), 4).alias("cross_symbol"), F.round(F.lit(inside.balanced_accuracy), 4).alias("in_sample"), F.round(F.lit(of.majority_accuracy), 4).alias("majority"))
            found = row if found is None else found.unionByName(row)
    return found

