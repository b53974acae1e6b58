"""Results on disk: whole, by model, and resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").format(kind).save(path)


def save_part(df: DataFrame, path: str, by: str = "model") -> None:
    """Replaces the rows of the values of `by` that df holds, and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def save_paths(df: DataFrame, path: str) -> None:
    """Simulated paths (model, version, seed, t, r) as single-precision values."""
    df.withColumn("r", F.col("r").cast("float")).write.mode("overwrite").partitionBy("model", "version").parquet(path)


def load(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(kind).load(path)


def unfinished(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of wanted whose keys aren't in done."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def resumed(wanted: DataFrame, done: DataFrame, keys: list[str], compute) -> DataFrame:
    """Rows already there, and those that compute(rest) makes for the rest, with the same columns."""
    return done.unionByName(compute(unfinished(wanted, done, keys)))
