"""Stages of a long computation, kept as tables: what has been committed isn't computed again when a run starts anew.

A stage's rows for some models are one folder, which counts once Spark has put its commit marker there; a run that dies in
between leaves a folder without one, which is passed over. Rows of models that a stage lacks are added as another folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "_SUCCESS"


class Stages:
    def __init__(self, spark: SparkSession, folder: str, version: str, schema: str):
        """schema: of all stages' rows; it has a column model."""
        self.spark, self.folder, self.schema = spark, f"{folder.rstrip('/')}/version={version}", schema
        self.made: list[tuple[str, tuple[str, ...]]] = []  # what this run had to compute

    def committed(self, stage: str) -> list[str]:
        """The folders of a stage that are whole."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        top = path(f"{self.folder}/stage={stage}")
        store = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(top):
            return []
        return sorted(str(s.getPath()) for s in store.listStatus(top) if store.exists(path(s.getPath(), MARKER)))

    def rows(self, stage: str) -> DataFrame:
        """All rows of a stage so far."""
        names = self.committed(stage)
        return self.spark.read.schema(self.schema).parquet(*names) if names else self.spark.createDataFrame([], self.schema)

    def of(self, stage: str, models: list[str], make: Callable[[list[str]], DataFrame]) -> DataFrame:
        """The stage's rows for the models; make(those it lacks) gives what is missing. A model that make gives no row for is made again."""
        done = {r.model for r in self.rows(stage).select("model").distinct().collect()}  # names of models
        missing = [m for m in models if m not in done]
        if missing:
            make(missing).write.parquet(f"{self.folder}/stage={stage}/{uuid.uuid4().hex}")
            self.made.append((stage, tuple(missing)))
        return self.rows(stage).where(F.col("model").isin(models))
