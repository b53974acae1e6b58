"""How operators keep and pass on intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.sources.shared import clear, dropped, shared_dir, stored

__all__ = ["broadcast_if_small", "clear", "dropped", "shared_dir", "small_batches", "stored"]

BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of a few numbers a row, marked for broadcast if it has at most `most` rows (16 MB of doc_ids)."""
    return F.broadcast(df) if df.count() <= most else df


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Has Spark hand texts to Python in batches of 8 MB, unless the session says otherwise: the default number of rows can
    be hundreds of MB of text, once in the JVM and once in Python, for every task."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(8 << 20))
