"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks. DataFrame functions only.

1. Targets: the budget is shared by weight; no source gets more than max_repeat times its own size, and what is over is
   shared again by weight until no source is above.
2. Seats: the budget, in blocks of block_words, goes to sources by highest quotients target / (2 j + 1), and each source's
   seats go to its shards in the same way by the shards' sizes. A source has shards in proportion to its size, so none of
   them grows with the corpus, whatever share one source holds.
3. Blocks: a shard's documents form a stream in seeded order, cut into blocks. Whole passes over the stream come first;
   the rest of the quota is taken from blocks in a seeded order of their own.

What a document adds is the overlap of its words with the blocks taken, counted for every pass. Orders come from hashes of
the seed and the rows' values: a rerun gives the same rows.

Cases: a null text has size 0, as has one of white space; documents of size 0 are never taken; a null source is a source of
its own, after all others; repeated rows are documents of their own; a corpus without words has targets of 0; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftglass.llm.storage import stored

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, max_repeat: float) -> DataFrame:
    """One row per source of sizes(source, size): sid (its rank), source, source_size, weight, target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # over one row per source
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("sid", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", max_repeat * F.col("source_size"))
    # in order of cap / weight: with all before at their caps, the others share the rest; the first share that fits holds
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    share = (budget * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    sources = sources.withColumn("share", share)
    fits = F.col("share") * F.col("weight") <= F.col("cap")
    sources = sources.withColumn("fits", F.when(fits, F.struct(F.row_number().over(order).alias("at"), F.col("share").alias("level"))))
    sources = sources.withColumn("level", F.min("fits").over(Window.partitionBy())["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return sources.select("sid", "source", "source_size", "weight", target.alias("target"))


def apportion(groups: DataFrame, by: list[str], votes: str, seats: Column, name: str, ties: list[str]) -> DataFrame:
    """Adds column `name`: of the seats of each `by`, those that go to the row by highest quotients votes / (2 j + 1).

    A row surely gets the seats well below its even share; only the quotients near it compete, a few for each row. How near
    is near: rounding all rows shifts the divisor by half a seat for each row of the group at most.
    """
    whole = Window.partitionBy(*by)
    even = F.coalesce(F.try_divide(F.col(votes) * F.col("_seats"), F.sum(votes).over(whole)), F.lit(0.0))
    part = F.coalesce(F.try_divide(F.col(votes).cast("double"), F.sum(votes).over(whole).cast("double")), F.lit(0.0))
    rows = groups.withColumn("_seats", seats)
    rows = rows.withColumn("_even", F.round(even).cast("long")).withColumn("_near", F.ceil(part * F.count("*").over(whole)) + 2)
    rows = rows.withColumn("_sure", F.when(F.col(votes) > 0, F.greatest(F.lit(0), F.col("_even") - F.col("_near"))).otherwise(0))
    tried = F.when(F.col(votes) > 0, F.sequence("_sure", F.col("_even") + F.col("_near"))).otherwise(F.array(F.lit(0).cast("long")))
    open_seats = F.col("_seats") - F.sum("_sure").over(whole)
    rows = rows.withColumn("_open", open_seats).withColumn("_j", F.explode(tried))
    best = Window.partitionBy(*by).orderBy((F.col(votes) / (2 * F.col("_j") + 1)).desc(), *ties)
    won = (F.row_number().over(best) <= F.col("_open")) & (F.col(votes) > 0)
    rows = rows.withColumn("_won", won.cast("long"))
    return rows.groupBy(*groups.columns).agg((F.first("_sure") + F.sum("_won")).alias(name))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    budget: float = 1.5,
    max_repeat: float = 2.0,
    block_words: int = 128,
    shard_words: int = 4_000_000,
    seed: int = 17,
) -> DataFrame:
    """One row per document of docs(doc_id, text, source): doc_id, size, source_size, target, taken."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = stored(docs.select("doc_id", "source", size.alias("size")), "sizes")
    sources = stored(targets(sizes, weights, budget, max_repeat), "sources")
    sources = apportion(sources, [], "target", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long"), "seats", ["sid"])
    sources = sources.withColumn("shards", F.ceil((F.col("source_size") + 1) / shard_words).cast("long"))

    rows = sizes.join(sources.select(F.col("source").alias("s"), "sid", "source_size", "target", "seats", "shards"), F.col("source").eqNullSafe(F.col("s")))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards")))
    stream = Window.partitionBy("sid", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size")
    stop = F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size"))
    rows = stored(rows.select("sid", "shard", "doc_id", "size", "source_size", "target", "seats", "start", "stop"), "streams")

    shards = rows.groupBy("sid", "shard", "seats").agg(F.sum("size").alias("words"))
    shards = apportion(shards, ["sid"], "words", F.col("seats"), "quota", ["shard"])
    want = F.least(F.col("quota") * block_words, F.floor(max_repeat * F.col("words")))
    passes = F.coalesce(F.try_divide(want, F.col("words")), F.lit(0)).cast("long")
    shards = shards.withColumn("passes", passes).withColumn("rest", want - F.col("passes") * F.col("words"))
    shards = stored(shards.where("words > 0").select("sid", "shard", "words", "passes", "rest"), "quotas")

    blocks = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / block_words))))
    blocks = blocks.withColumn("length", F.least(F.lit(block_words), F.col("words") - F.col("block") * block_words))
    chosen = Window.partitionBy("sid", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "sid", "shard", "block"), "block")
    before = F.sum("length").over(chosen.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    blocks = blocks.withColumn("take", F.greatest(F.lit(0), F.least(F.col("length"), F.col("rest") - before)))
    place = Window.partitionBy("sid", "shard").orderBy("block")
    so_far = F.sum("take").over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("take")
    blocks = stored(blocks.select("sid", "shard", "block", "passes", "take", so_far.alias("so_far")), "blocks")

    # words taken of the stream before a place: those of all blocks before its block, and the part taken of its block
    out = rows.withColumn("b0", F.floor(F.col("start") / block_words)).withColumn("b1", F.floor((F.col("stop") - 1) / block_words))
    for end, at, of in (("b0", "start", "upto_start"), ("b1", "stop", "upto_stop")):
        found = blocks.select("sid", "shard", F.col("block").alias(end), "take", "so_far", *(["passes"] if end == "b0" else []))
        out = out.join(found, ["sid", "shard", end], "left")
        out = out.withColumn(of, F.col("so_far") + F.least(F.col("take"), F.col(at) - F.col(end) * block_words)).drop("take", "so_far")
    taken = F.when(F.col("size") > 0, F.col("passes") * F.col("size") + F.col("upto_stop") - F.col("upto_start")).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
