"""The text audit as a stream: files that arrive are audited a few at a time, and what is done is kept at once.

A batch is written to a folder of its own number, over whatever an earlier attempt has left there. The stream's checkpoint gives a batch
that was cut off the same number and the same files when it runs again, so every document counts exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftglass.functions import text

FILES = 20  # fixed value: how many inputs are audited between two writes


def arriving(spark: SparkSession, folder: str, schema: str, files: int = FILES, kind: str = "parquet") -> DataFrame:
    """The files of a folder as a stream, `files` of them a batch."""
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files).load(folder)


def written(out: str, then: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """Writes a batch below `out`; `then` is told its number afterwards."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if then:
            then(number)

    return write


def audit_stream(documents: DataFrame, out: str, checkpoint: str, doc_id: str = "doc_id", body: str = "text", then: Callable[[int], None] | None = None, **audit) -> StreamingQuery:
    """Starts the audit of a stream of documents over what there is now; `results` reads what it has written."""
    rows = text.audit(documents, doc_id, body, **audit)
    return rows.writeStream.foreachBatch(written(out, then)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, out: str) -> DataFrame:
    """All audited documents so far, and the batch that each came with."""
    return spark.read.parquet(out)


def progress(audited: DataFrame) -> DataFrame:
    """batch, documents, fetched, and both summed over the batches so far."""
    rows = audited.groupBy("batch").agg(F.count("*").alias("documents"), F.count_if("fetched").alias("fetched"))
    upto = rows.select(F.col("batch").alias("at"))  # a row a batch
    sums = upto.join(rows, F.col("batch") <= F.col("at")).groupBy(F.col("at").alias("batch")).agg(F.sum("documents").alias("documents_so_far"), F.sum("fetched").alias("fetched_so_far"))
    return rows.join(sums, "batch")
