"""Sliding windows by count over numbered series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, STRIDE = 1000, 250


def with_length(rows: DataFrame, by: str) -> DataFrame:
    return rows if "n" in rows.columns else rows.join(rows.groupBy(by).agg((F.max("i") + 1).alias("n")), by)


def sliding(rows: DataFrame, window: int = WINDOW, stride: int = STRIDE, by: str = "series_id") -> DataFrame:
    """by, start, i, r: every full window of `window` rows that starts at a multiple of stride; a row is in several.

    Each row finds its windows by arithmetic; the lengths of the series are joined where rows lack them as n.
    """
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - window + 1) / stride))
    last = F.floor(F.least(F.col("i"), F.col("n") - window) / stride)
    rows = with_length(rows, by).where(F.col("n") >= window).withColumn("first", first).withColumn("last", last).where("first <= last")
    rows = rows.withColumn("start", F.explode(F.sequence("first", "last")))
    return rows.select(by, (F.col("start") * stride).cast("long").alias("start"), "i", "r")


def tail(rows: DataFrame, n: int = WINDOW, by: str = "series_id") -> DataFrame:
    """The last n rows of every series, as a window of its own."""
    rows = with_length(rows, by).where(F.col("i") >= F.col("n") - n)
    return rows.select(by, (F.greatest(F.lit(0), F.col("n") - n)).cast("long").alias("start"), "i", "r")
