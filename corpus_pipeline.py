"""From raw documents to a mixture: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage reads what the one before has written, all of it. Decisions are made on rows: where doc_ids repeat or are null,
rows get numbers of their own for the stages that decide by id, so a row never goes because of another with its doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.llm import decontamination, language_id, line_dedup, mixing, near_dedup
from driftglass.llm.storage import broadcast_if_small, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Learned from labelled rows, as the query op2_language_id does."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.accepted(docs, model)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(docs).withColumn("n_chars", F.length("text").cast("long"))


def without(docs: DataFrame, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs without the rows whose doc_ids found(docs) gives."""
    kept = "_own_id"
    while kept in docs.columns:
        kept += "_"
    rows = docs.withColumn(kept, F.col("doc_id"))
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("rows"))
    shared = stored(ids.where("doc_id IS NULL OR rows > 1").select(F.col("doc_id").alias(kept)), "shared-ids")
    if shared.take(1):  # numbers above all ids
        most = docs.agg(F.max("doc_id")).first()[0] or 0
        known = broadcast_if_small(shared.withColumn("doc_id", F.lit(True)))
        rows = rows.drop("doc_id").join(known.withColumnRenamed(kept, kept + "s"), F.col(kept).eqNullSafe(F.col(kept + "s")), "left").drop(kept + "s")
        number = F.lit(max(most + 1, 1 << 60)) + F.monotonically_increasing_id()
        rows = stored(rows.withColumn("doc_id", F.when(F.col("doc_id"), number).otherwise(F.col(kept))), "numbered")
    gone = stored(found(rows.drop(kept)).select("doc_id").distinct(), "gone")
    out = rows.join(broadcast_if_small(gone), "doc_id", "left_anti")
    return out.withColumn("doc_id", F.col(kept)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, lambda rows: near_dedup.near_duplicates(rows).where("NOT kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, lambda rows: decontamination.contaminated(rows, benchmark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
