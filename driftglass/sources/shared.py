"""Intermediate tables, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where a session names none: the warehouse, or a fresh local folder if the
    session runs on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        named = tempfile.mkdtemp(prefix="spark-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, and a lost executor costs one task.

    The shuffle files of the write are dropped when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def dropped(df: DataFrame) -> None:
    """Deletes a table that `stored` has written, once nothing will read it again."""
    for name in df.inputFiles()[:1]:
        delete(df.sparkSession, name.rpartition("/")[0])


def clear(spark: SparkSession) -> None:
    """Deletes all tables that `stored` has written in this process; results that read them are no longer valid."""
    while _made:
        delete(spark, _made.pop())
