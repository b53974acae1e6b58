"""Operators on ordered rows: runs, cumulative paths, ranks and cumulative counts of two samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS, PART = 64, 1 << 16


def parted(rows: DataFrame, key, part: int = PART) -> DataFrame:
    """Adds _part, stretches of a key by i that a task can hold in order."""
    return rows.withColumn("_part", F.floor(F.col("i") / part))


def zero_runs(rows: DataFrame, key=("series_id",), tiny: float = 1e-12, part: int = PART) -> DataFrame:
    """key, longest: the longest run of values that are zero, 0 without any; a null breaks a run.

    A part of a key gives a summary (rows, place of its first and last other value, longest run between two); runs that cross parts
    come from the summaries, a row a part, so that no task orders a whole key.
    """
    ordered = Window.partitionBy(*key, "_part").orderBy("i")
    flat = parted(rows.select(*key, "i", "r"), key, part).withColumn("_at", F.row_number().over(ordered).cast("long"))
    flat = flat.withColumn("_other", F.when(~F.coalesce(F.abs("r") < tiny, F.lit(False)), F.col("_at")))
    flat = flat.withColumn("_gap", F.col("_other") - F.last("_other", True).over(ordered.rowsBetween(Window.unboundedPreceding, -1)) - 1)
    about = flat.groupBy(*key, "_part").agg(F.count("*").alias("n"), F.min("_other").alias("first"), F.max("_other").alias("last"), F.max("_gap").alias("gap"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    about = about.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    about = about.withColumn("held", F.coalesce(F.max(F.col("offset") + F.col("last")).over(before), F.lit(0)))
    total = about.groupBy(*key).agg(F.max("gap").alias("inner"), F.max(F.col("offset") + F.col("first") - F.col("held") - 1).alias("across"), F.sum("n").alias("n"), F.max(F.col("offset") + F.col("last")).alias("end"))
    return total.select(*key, F.greatest("inner", "across", F.col("n") - F.coalesce("end", F.lit(0))).alias("longest"))


def cumulative(rows: DataFrame, values: dict, key=("series_id",), part: int = PART) -> DataFrame:
    """Adds a column for each of values (name: expression): its running sum, within parts and over the totals of those before."""
    rows = parted(rows, key, part)
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*key, "_part").agg(*(F.sum(v).alias(f"_{n}") for n, v in values.items()))  # a row a part
    totals = totals.select(*key, "_part", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0.0)).alias(f"_{n}") for n in values))
    inside = Window.partitionBy(*key, "_part").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.sum(v).over(inside) for n, v in values.items()}).join(totals, [*key, "_part"])
    return rows.withColumns({n: F.col(n) + F.col(f"_{n}") for n in values}).drop("_part", *(f"_{n}" for n in values))


def cumulative_paths(rows: DataFrame, key=("series_id",), part: int = PART) -> DataFrame:
    """Adds path: the running sum of r."""
    return cumulative(rows, {"path": F.col("r")}, key, part)


def trailing_slices(rows: DataFrame, length: str, key=("series_id",), part: int = PART) -> DataFrame:
    """Adds mean and variance of r over the last rows.length values of its key, the row's own included (fewer at the start);
    null for a length under 1. rows are numbered by i without gaps.

    Lengths differ from row to row, so no window fits: sums of r and of its square up to the row are compared with those up to the
    row before the slice, which is looked up by number. Values are taken from the mean of the key first, for the digits' sake.
    """
    middle = rows.groupBy(*key).agg(F.avg("r").alias("_middle"), F.min("i").alias("_least"))
    sums = cumulative(rows.join(middle, list(key)).withColumn("_x", F.col("r") - F.col("_middle")), {"s1": F.col("_x"), "s2": F.col("_x") * F.col("_x")}, key, part)
    sums = sums.withColumn("_from", F.greatest(F.col("i") - F.col(length), F.col("_least") - 1))
    behind = sums.select(*key, F.col("i").alias("_from"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    met = sums.where(F.col(length) >= 1).select(*key, "i", "_from", "_middle", "s1", "s2").join(behind, [*key, "_from"], "left")
    n = F.col("i") - F.col("_from")
    mean = (F.col("s1") - F.coalesce("b1", F.lit(0.0))) / n
    square = (F.col("s2") - F.coalesce("b2", F.lit(0.0))) / n
    met = met.select(*key, "i", (mean + F.col("_middle")).alias("mean"), F.greatest(square - mean * mean, F.lit(0.0)).alias("variance"))
    return rows.join(met, [*key, "i"], "left")


def autocorrelations(rows: DataFrame, lags: list[int], value: Column, key=("series_id",), part: int = PART) -> DataFrame:
    """key, lag, acf of value over whole series numbered by i without gaps, of any length; null without spread.

    A part also gets the rows before it that its lags reach, so lags need no order over a whole key.
    """
    most = max(lags)
    part = max(part, most)
    rows = rows.select(*key, "i", value.alias("x"))
    rows = rows.join(rows.groupBy(*key).agg(F.avg("x").alias("middle")), list(key)).withColumn("x", F.col("x") - F.col("middle"))
    own = F.floor(F.col("i") / part)
    rows = rows.withColumn("own", own).withColumn("_part", F.explode(F.when(F.col("i") % part >= part - most, F.array(own, own + 1)).otherwise(F.array(own))))
    ordered = Window.partitionBy(*key, "_part").orderBy("i")
    rows = rows.select(*key, "x", (F.col("own") == F.col("_part")).alias("mine"), *(F.lag("x", k).over(ordered).alias(f"x{k}") for k in lags)).where("mine")
    sums = rows.groupBy(*key).agg(F.sum(F.col("x") * F.col("x")).alias("all"), *(F.sum(F.col("x") * F.col(f"x{k}")).alias(f"s{k}") for k in lags))
    found = F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.try_divide(f"s{k}", F.nullif(F.col("all"), F.lit(0.0))).alias("acf")) for k in lags))).alias("f")
    return sums.select(*key, found).select(*key, "f.*")


def smoothed_autocorrelations(rows: DataFrame, lags: list[int], value: Column, key=("series_id",), part: int = PART) -> DataFrame:
    """key, lag, acf: the mean of a lag's and its neighbours' autocorrelation (of lag 1: the first two)."""
    around = {k: [j for j in (k - 1, k, k + 1) if j > 0] for k in lags}
    found = autocorrelations(rows, sorted({j for js in around.values() for j in js}), value, key, part).withColumnRenamed("lag", "near")
    near = rows.sparkSession.createDataFrame([(k, j) for k, js in around.items() for j in js], "lag int, near int")
    return found.join(F.broadcast(near), "near").groupBy(*key, "lag").agg(F.when(F.count("acf") == F.count("*"), F.avg("acf")).alias("acf"))


def path_bands(paths: DataFrame, by=("start",)) -> DataFrame:
    """Median and 1 and 99 percent of paths at each step."""
    return paths.groupBy(*by, "step").agg(F.count("*").alias("paths"), F.median("path").alias("median"), F.percentile("path", F.lit(0.01)).alias("lo"), F.percentile("path", F.lit(0.99)).alias("hi"))


def mid_ranks(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Adds rank: that of the value within `by`, ties sharing the mean of their places; null for a null value, which counts for none.

    Ranks are of distinct values, cumulated in ranges, so that one large group isn't sorted in one task."""
    counts = joint_counts(rows.select(*by, F.col(value).alias("value"), F.lit("a").alias("side")), by)
    ranks = counts.select(*by, F.col("value").alias(value), (F.col("cum_a") - F.col("a") + (F.col("a") + 1) / 2).alias("rank"))
    return rows.join(ranks, [*by, value], "left")


def joint_counts(samples: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """For each distinct value of two samples(by, side, value): how many of 'a' and 'b' equal it, and lie at or below it. weight:
    a column of whole numbers, how often a row counts.

    Values are first counted, then cumulated within ranges between approximate quantiles and over the ranges, so that one
    large sample isn't sorted in one task.
    """
    counts = samples.where("value IS NOT NULL").groupBy(*by, "value").agg(*(F.sum(F.when(F.col("side") == s, F.col(weight) if weight else F.lit(1)).otherwise(0)).cast("long").alias(s) for s in "ab"))
    cuts = counts.groupBy(*by).agg(F.percentile_approx("value", [k / CUTS for k in range(1, CUTS)], 1000).alias("cuts"))
    counts = counts.join(cuts, by).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy(*by, "part").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"))
    parts = parts.select(*by, "part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in ("pa", "pb")), *(F.sum(c).over(Window.partitionBy(*by)).alias(n) for c, n in (("pa", "n_a"), ("pb", "n_b"))))
    inside = Window.partitionBy(*by, "part").orderBy("value")
    out = counts.withColumn("ca", F.sum("a").over(inside)).withColumn("cb", F.sum("b").over(inside)).join(parts, [*by, "part"])
    return out.select(*by, "value", "a", "b", (F.col("ca") + F.col("before_pa")).alias("cum_a"), (F.col("cb") + F.col("before_pb")).alias("cum_b"), "n_a", "n_b")


def percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by, share, value: exact percentiles of groups of any size, between neighbours as usual; nulls count for nothing.

    Distinct values are counted and cumulated in ranges, and each wanted place is the least value whose count reaches beyond it, so
    no state holds the values of a group."""
    counts = joint_counts(rows.select(*by, F.col(value).alias("value"), F.lit("a").alias("side")), by)
    places = {k: F.lit(float(p)) * (F.col("n_a") - 1) for k, p in enumerate(shares)}
    at = lambda place: F.min(F.when(F.col("cum_a") > place, F.col("value")))
    held = counts.groupBy(*by).agg(F.max("n_a").alias("n_a"), *(at(f(x)).alias(f"{n}{k}") for k, x in places.items() for n, f in (("lo", F.floor), ("hi", F.ceil))))
    between = lambda k: F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * (places[k] - F.floor(places[k]))
    found = F.explode(F.array(*(F.struct(F.lit(float(p)).alias("share"), between(k).alias("value")) for k, p in enumerate(shares)))).alias("f")
    return held.select(*by, found).select(*by, "f.*")
