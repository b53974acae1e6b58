"""How far conclusions depend on overlap, strata and tail fractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass.operators import battery, twosample


def effective_n(long: DataFrame, period: str = "start") -> DataFrame:
    """stat, n, deff, n_eff: the number of windows less what they share with others of the same period.

    Of the periods with two windows or more: mean variance within against the variance of all gives the correlation, the
    mean number of windows the size of a cluster.
    """
    groups = long.groupBy("stat", period).agg(F.count("*").alias("m"), F.var_pop("value").alias("within"))
    groups = groups.where("m > 1").groupBy("stat").agg(F.avg("m").alias("m"), F.avg("within").alias("within"))
    total = long.groupBy("stat").agg(F.count("*").alias("n"), F.var_pop("value").alias("total"))
    rho = F.least(F.greatest(1 - F.try_divide("within", "total"), F.lit(0.0)), F.lit(0.99))
    deff = F.when((F.col("total") > 0) & F.col("m").isNotNull(), 1 + (F.col("m") - 1) * rho).otherwise(1.0)
    return total.join(groups, "stat", "left").select("stat", "n", deff.alias("deff"), (F.col("n") / deff).alias("n_eff"))


def interval_inflation(effective: DataFrame) -> DataFrame:
    """median_n_eff over the statistics and how much wider intervals get by it."""
    return effective.agg(F.median("n_eff").alias("median_n_eff"), F.sqrt(F.max("n") / F.median("n_eff")).alias("inflation"))


def by_stratum(real: DataFrame, synthetic: DataFrame, stratum: str = "series_id") -> DataFrame:
    """stat, stratum, ks of every stratum of real windows against all synthetic ones, and of all strata together (null)."""
    strata = real.select("stat", stratum, "value").unionByName(real.select("stat", F.lit(None).cast("string").alias(stratum), "value"))
    names = strata.select(stratum).distinct()
    other = synthetic.select("stat", "value").join(F.broadcast(names))  # names of strata
    both = strata.withColumn("side", F.lit("a")).unionByName(other.withColumn("side", F.lit("b")))
    both = both.withColumn("stratum", F.coalesce(F.col(stratum), F.lit("all")))
    return twosample.compared(both.select("stat", "stratum", "side", "value"), ["stat", "stratum"]).select("stat", "stratum", "n_a", "ks")


def tail_sweep(real: DataFrame, synthetic: DataFrame, fracs=(0.025, 0.05, 0.10), synthetic_key=("generator", "run")) -> DataFrame:
    """side_of_tail, frac, generator, ks, real_median: real windows against the same synthetic paths for every tail fraction."""
    a = battery.hill_sweep(real, fracs).select(F.col("side").alias("tail"), "frac", F.col("hill").alias("value"))
    b = battery.hill_sweep(synthetic, fracs, synthetic_key).select("generator", F.col("side").alias("tail"), "frac", F.col("hill").alias("value"))
    found = twosample.compared(twosample.two_sides(a, b), ["tail", "frac", "generator"]).select("tail", "frac", "generator", "ks")
    return found.join(a.groupBy("tail", "frac").agg(F.median("value").alias("real_median")), ["tail", "frac"])
