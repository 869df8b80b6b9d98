"""A cache of computed columns, addressed by what they were computed from.

An address is a hash of everything that the computation depends on besides its rows: a model, its settings, a version. Under it
lie parts, each written by one run; a part counts once its marker is there, which is renamed into place after all of the
part's files. A row is held under its ids and a hash of its contents, so changed rows are computed anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import put_text
from .manifests import cache_key


class EmbeddingCache:
    """What `compute` gave for rows under one address, in a folder that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, folder: str, payload: dict):
        self.spark, self.path = spark, f"{folder.rstrip('/')}/{cache_key(payload)}"

    def parts(self) -> list[str]:
        """The whole parts, oldest first."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*.complete.json")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        held = sorted((f.getModificationTime(), f.getPath().getName()) for f in found or [])
        return [f"{self.path}/{name.removesuffix('.complete.json')}" for _, name in held]

    def read(self) -> DataFrame | None:
        parts = self.parts()
        return self.spark.read.parquet(*parts) if parts else None

    def _put(self, rows: DataFrame) -> None:
        name = f"{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        put_text(self.spark, f"{self.path}/{name}.complete.json", json.dumps({"rows": self.spark.read.parquet(f"{self.path}/{name}").count()}))

    def through(self, frame: DataFrame, ids: list[str], columns: list[str], compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
        """(`frame` with what `compute` adds to it, how many rows had to be computed).

        `compute` takes rows like those of `frame` and gives ids and new columns of its own; it is called for rows that are not held,
        those whose ids are new or whose `columns` have changed, and not at all if there are none. Either all rows that were
        missing are in the cache afterwards or, if it fails, none of them. Ids are distinct and not null.
        """
        content = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
        rows = frame.withColumn("_content", content)
        held = self.read()
        missing = rows if held is None else rows.join(held.select(*ids, "_content"), [*ids, "_content"], "left_anti")
        n = missing.count()
        if n:
            made = compute(missing.drop("_content"))
            new = [c for c in made.columns if c not in frame.columns]
            self._put(missing.select(*ids, "_content").join(made.select(*ids, *new), ids))
            held = self.read()
        if held is None:
            return compute(frame), 0
        # Two runs may have computed a row at a time; both gave the same.
        held = held.dropDuplicates([*ids, "_content"])
        return rows.join(held, [*ids, "_content"]).drop("_content"), n
