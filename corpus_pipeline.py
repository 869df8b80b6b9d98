"""A training-data pipeline: five operators, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, exact_dedup, langid, mixing, shingles
from barloom.llm._common import fresh_dir, table


#: Of a language's mean posterior over a document's words. Short and mixed documents are below a half, and fine.
LEAST_POSTERIOR = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which some language stands out stay; those without letters go. Learned from the stage's input."""
    return langid.keep_identified(docs, langid.fit(docs), LEAST_POSTERIOR)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the most code points, then the smallest doc_id, stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by SimHash, as operator 9 links them, or by four fifths of their five-word shingles the smallest doc_id stays."""
    return shingles.drop_near_copies(docs, fingerprints=True)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: the documents of which it takes words, whole, with how many in a column more."""
    mixed = mixing.mix(docs, keep=tuple(docs.columns))
    return mixed.filter(F.col(mixed.columns[-1]) > 0)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash", near), ("decontaminate", benchmark), ("mixing", mix)]

#: The first stage is learned, and the third hashes by XXH64: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of the documents that all stages keep: the columns of `documents`, and taken.

    Each stage's result is written as Parquet in the shared folder and read again. Null and empty texts have no letters and go in
    the first stage, as do all rows of a table without texts; of repeated rows one stays. An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
