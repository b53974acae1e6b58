"""Choice among candidate models by the statistics of their paths: gates, medians over seeds, losses, and reports on them.

Candidates come as a table of paths (candidate, seed, i, r); every step is one job over all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftglass.operators import battery
from driftglass.operators.sequence import zero_runs
from driftglass.sources.shared import stored

# What is fitted, and the gates' limits.
FITTED = ("excess_kurtosis", "acf_abs_1", "acf_return_1")
MAX_ZERO_RUN, MIN_LENGTH, MIN_PATH_SPREAD, FLAT_TAIL, QUORUM_PATHS = 50, 900, 0.02, 50, 5
# End of fixed values.


def gated(paths: DataFrame, key=("candidate", "seed")) -> DataFrame:
    """key, reason: null for a valid path, or the first gate that it fails."""
    ordered = Window.partitionBy(*key)
    rows = paths.withColumn("back", F.row_number().over(ordered.orderBy(F.col("i").desc())))
    bad = F.count_if(F.col("r").isNull() | F.isnan("r") | (F.abs("r") == float("inf")))
    tail = F.when(F.col("back") <= FLAT_TAIL, F.col("r"))
    about = rows.groupBy(*key).agg(F.count("*").alias("n"), bad.alias("bad"), F.stddev_pop("r").alias("sd"), F.stddev_pop(tail).alias("tail_sd"))
    about = about.join(zero_runs(paths, key), list(key))
    reason = F.when(F.col("n") < MIN_LENGTH, "short").when(F.col("bad") > 0, "not finite").when(F.col("sd") <= 0, "constant")
    reason = reason.when(F.col("tail_sd") < 1e-9, "stopped").when(F.col("longest") > MAX_ZERO_RUN, "zero run")
    return about.select(*key, reason.alias("reason"))


def zero_share_gate(paths: DataFrame, key=("candidate", "seed"), most: float = 0.03) -> DataFrame:
    """An older gate, kept for comparison: too many zeros, wherever they stand."""
    return paths.groupBy(*key).agg(F.avg((F.abs("r") < 1e-12).cast("double")).alias("zeros")).select(*key, F.when(F.col("zeros") > most, "zeros").alias("reason"))


def deterministic(paths: DataFrame) -> DataFrame:
    """candidate, deterministic: whether the ends of its standardised paths hardly differ."""
    ends = paths.groupBy("candidate", "seed").agg(F.try_divide(F.sum("r"), F.nullif(F.stddev_pop("r"), F.lit(0.0))).alias("end"), F.count("*").alias("n"))
    out = ends.groupBy("candidate").agg((F.stddev_pop("end") / F.sqrt(F.max("n"))).alias("spread"), F.count("*").alias("paths"))
    return out.select("candidate", ((F.col("paths") >= QUORUM_PATHS) & (F.col("spread") < MIN_PATH_SPREAD)).alias("deterministic"))


def rejections(gates: DataFrame, by: tuple[str, ...] = ("candidate",)) -> DataFrame:
    """by, reason, paths: how many paths failed each gate."""
    return gates.where("reason IS NOT NULL").groupBy(*by, "reason").agg(F.count("*").alias("paths"))


def drift_range(facts: DataFrame) -> tuple[float, float]:
    """The 2.5 and 97.5 percent of the drift of real windows."""
    row = facts.agg(F.percentile("drift", F.lit(0.025)).alias("lo"), F.percentile("drift", F.lit(0.975)).alias("hi")).first()
    return row.lo, row.hi


def target_and_scale(windows: DataFrame, last: DataFrame) -> DataFrame:
    """stat, target, scale: the last window's statistics, and their spread over all windows (null if one is undefined)."""
    long = battery.unpivoted(battery.evaluate(windows))
    scale = long.groupBy("stat").agg(F.when(F.count("value") == F.count("*"), F.stddev_pop("value")).alias("scale"))
    return battery.unpivoted(battery.evaluate(last)).select("stat", F.col("value").alias("target")).join(scale, "stat")


def medians(paths: DataFrame, wanted: int, drift_range: tuple | None) -> tuple[DataFrame, DataFrame]:
    """(candidate, stat, value) of candidates that pass all gates, and (candidate, reason, paths) of the rejections."""
    gates = gated(paths)
    fine = paths.join(gates.where("reason IS NULL").select("candidate", "seed"), ["candidate", "seed"])
    facts = stored(battery.evaluate(fine, ("candidate", "seed")), "facts")
    long = battery.unpivoted(facts, ("candidate", "seed"))
    judged = facts.groupBy("candidate").agg(F.count("*").alias("valid"), F.median("drift").alias("drift")).join(deterministic(fine), "candidate")
    quorum = max(2, wanted // 2)
    why = F.when(F.col("valid") < quorum, "quorum")
    if drift_range:
        why = why.when(~F.coalesce(F.col("drift").between(*drift_range), F.lit(False)), "drift")
    judged = judged.withColumn("reason", why.when(F.col("deterministic"), "deterministic"))
    stats = long.join(judged.where("reason IS NULL").select("candidate"), "candidate").groupBy("candidate", "stat")
    stats = stats.agg(F.when(F.count("value") == F.count("*"), F.median("value")).alias("value"))
    return stats, rejections(gates).unionByName(judged.where("reason IS NOT NULL").select("candidate", "reason", F.col("valid").alias("paths")))


def losses(stats: DataFrame, target: DataFrame, fitted=FITTED) -> DataFrame:
    """candidate, loss: squared distances of the fitted statistics in units of their scale; null if one is undefined."""
    z = F.pow((F.col("value") - F.col("target")) / F.col("scale"), 2)
    rows = stats.where(F.col("stat").isin(list(fitted))).join(target, "stat").withColumn("z2", z)
    return rows.groupBy("candidate").agg(F.when(F.count("z2") == len(fitted), F.sum("z2")).alias("loss"))


def search(paths: DataFrame, target: DataFrame, wanted: int, drift_range: tuple | None = None, fitted=FITTED) -> DataFrame:
    """candidate, loss, reason of all candidates with `wanted` seeds each: those rejected have a reason and no loss."""
    stats, rejected = medians(paths, wanted, drift_range)
    why = rejected.groupBy("candidate").agg(F.max_by("reason", F.struct("paths", "reason")).alias("reason"))
    out = losses(stats, target, fitted).join(why, "candidate", "full")
    return out.select("candidate", "loss", F.when(F.col("loss").isNull(), F.col("reason")).alias("reason"))


def hold_out(long: DataFrame, model: str, seed: str, first: int) -> DataFrame:
    """model, stat, fitted, held_out: medians over the seeds below `first`, and over those from it on, which no search has seen."""
    part = lambda c: F.median(F.when(c, F.col("value")))
    return long.groupBy(model, "stat").agg(part(F.col(seed) < first).alias("fitted"), part(F.col(seed) >= first).alias("held_out"))


def at_bound(params: DataFrame) -> DataFrame:
    """model, at_bound: of params(model, param, value, lo, hi), those within 2 percent of an edge; weights w_* are exempt."""
    share = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    edge = ((share <= 0.02) | (share >= 0.98)) & ~F.col("param").startswith("w_")
    return params.groupBy("model").agg(F.array_sort(F.collect_set(F.when(edge, F.col("param")))).alias("at_bound"))


def on_simplex(params: DataFrame, weights: list[str]) -> DataFrame:
    """Weights divided by their sum."""
    total = sum((F.col(w) for w in weights), F.lit(0.0))
    return params.withColumns({w: F.try_divide(F.col(w), total) for w in weights})


def overridden(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Search ranges(model, param, lo, hi) with those that changes give."""
    new = changes.select("model", "param", F.col("lo").alias("new_lo"), F.col("hi").alias("new_hi"))
    return base.join(new, ["model", "param"], "left").select("model", "param", F.coalesce("new_lo", "lo").alias("lo"), F.coalesce("new_hi", "hi").alias("hi"))


def frontier(found: DataFrame, k: int = 400) -> DataFrame:
    """The k candidates of least loss; a report."""
    return found.orderBy("loss", "candidate").limit(k)
