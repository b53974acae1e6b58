"""Search for the parameters of models whose paths come nearest to a target: default, low-discrepancy draws, refinement by
coordinates, and a hold-out of seeds that no stage has seen.

Every stage is one evaluation of all its candidates, over all models and starts at once, and is kept as a table
(`sources.stages`): a run that is started again goes on where the last one stopped. What the driver holds are the best points.
An evaluation is any function of candidates(candidate, model, params) to (candidate, loss, reason); `evaluated` is the one that
draws paths of the generators.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.functions import keyed, sobol
from driftglass.operators import battery, calibration, generators, reports
from driftglass.sources.shared import stored
from driftglass.sources.stages import Stages

KEPT = "model string, stage string, start int, candidate string, params map<string,double>, loss double, reason string"
CANDIDATE = "model string, start int, candidate string, params map<string,double>"
# The share of a range that a refining step takes, and what an improvement must exceed.
STEP, LEAST_GAIN = 0.07, 1e-9
# End of fixed values.

Range = tuple[float, float, bool, float | None]  # lo, hi, whole numbers only, default


def settled(value: float, of: Range) -> float:
    """A value within its range, whole where it has to be."""
    value = min(max(value, of[0]), of[1])
    return float(round(value)) if of[2] else float(value)


def preset(ranges: dict[str, Range]) -> dict[str, float]:
    """Each parameter's default, or the middle of its range."""
    return {p: float(r[3]) if r[3] is not None else (r[0] + r[1]) / 2 for p, r in ranges.items()}


def drawn(spark: SparkSession, models: dict[str, dict[str, Range]], draws: int, seed: int) -> DataFrame:
    """CANDIDATE: `draws` points of each model, spread evenly over the ranges of its parameters; start is the number of the point."""
    points = spark.range(draws).select(F.col("id").alias("k"))
    out = None
    for name, ranges in models.items():
        pairs: list[Column] = []
        for dim, (p, (lo, hi, whole, _)) in enumerate(sorted(ranges.items())):
            value = lo + (hi - lo) * sobol.point(F.col("k"), dim, seed, name)
            pairs += [F.lit(p), F.bround(value) if whole else value]
        row = points.select(F.lit(name).alias("model"), F.col("k").cast("int").alias("start"), F.concat_ws("|", F.lit(name), F.lit("draw"), F.col("k").cast("string")).alias("candidate"), F.create_map(*pairs).alias("params"))
        out = row if out is None else out.unionByName(row)
    return out


def as_candidates(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), CANDIDATE)


def better(rows: Iterable, than: float) -> tuple[dict, float] | None:
    """The least loss of the rows, if it is less; ties by name."""
    found = min(((r.loss, r.candidate, r.params) for r in rows if r.loss is not None and math.isfinite(r.loss)), key=lambda x: x[:2], default=None)
    return (dict(found[2]), found[0]) if found and found[0] < than else None


def search(
    spark: SparkSession, models: dict[str, dict[str, Range]], evaluate: Callable[[DataFrame], DataFrame], folder: str, version: str, draws: int, seed: int, starts: int = 1, passes: int = 1, step: float = STEP
) -> DataFrame:
    """model, params, loss, default_loss, evaluations of each model with a point that passes; kept below `folder` stage by stage.

    The default counts first; a draw, then a step, must be better to take its place. Refining goes from the best `starts` points
    (of the default and the draws), a coordinate at a time in order of name, both ways at once; the better way stays if it gains
    more than LEAST_GAIN. A start without a gain in a whole pass rests.
    """
    stages = Stages(spark, folder, version, KEPT)
    names = list(models)

    def judged(stage: str, candidates: DataFrame) -> DataFrame:
        candidates = stored(candidates, "candidates")
        found = evaluate(candidates.select("candidate", "model", "params"))
        return candidates.join(found, "candidate", "left").select("model", F.lit(stage).alias("stage"), "start", "candidate", "params", "loss", "reason")

    by_model = lambda df: {m: [r for r in rows if r.model == m] for rows in [df.collect()] for m in names}  # noqa: E731  candidates of a stage: as many as were asked for
    default = by_model(stages.of("default", names, lambda ms: judged("default", as_candidates(spark, [(m, 0, f"{m}|default", preset(models[m])) for m in ms]))))
    some = by_model(stages.of("draws", [m for m in names if models[m]], lambda ms: judged("draws", drawn(spark, {m: models[m] for m in ms}, draws, seed))))
    count = {m: len(default[m]) + len(some[m]) for m in names}
    at: dict[tuple[str, int], tuple[dict, float]] = {}
    for m in names:
        fine = sorted((r for r in [*default[m], *some[m]] if r.loss is not None and math.isfinite(r.loss)), key=lambda r: (r.loss, r.stage != "default", r.start))
        at |= {(m, k): (dict(r.params), r.loss) for k, r in enumerate(fine[:starts])}
    resting: set[tuple[str, int]] = set()
    for turn in range(passes):
        gained: set[tuple[str, int]] = set()
        for j in range(max((len(r) for r in models.values()), default=0)):
            rows = []
            for (m, k), (params, _) in at.items():
                if (m, k) in resting or j >= len(models[m]):
                    continue
                p = sorted(models[m])[j]
                lo, hi, *_ = models[m][p]
                rows += [(m, k, f"{m}|{turn}|{p}|{k}|{way}", params | {p: settled(params[p] + way * step * (hi - lo), models[m][p])}) for way in (-1, 1)]
            if not rows:
                continue
            stage = f"refine-{turn}-{j}"
            found = by_model(stages.of(stage, sorted({r[0] for r in rows}), lambda ms, rows=rows, stage=stage: judged(stage, as_candidates(spark, [r for r in rows if r[0] in ms]))))
            for m, k in {(r[0], r[1]) for r in rows}:
                own = [r for r in found[m] if r.start == k]
                count[m] += len(own)
                if new := better(own, at[m, k][1] - LEAST_GAIN):
                    at[m, k] = new
                    gained.add((m, k))
        resting |= set(at) - gained
    out = []
    for m in names:
        own = [v for (x, _), v in at.items() if x == m]
        if own:
            params, loss = min(own, key=lambda v: v[1])
            out.append((m, params, loss, default[m][0].loss if default[m] else None, count[m]))
    return spark.createDataFrame(out, "model string, params map<string,double>, loss double, default_loss double, evaluations int")


# The generators as models: what can be searched, in ranges around what is usual.
RANGES: dict[str, dict[str, Range]] = {
    "student_t": {"df": (2.5, 30.0, False, 5.0)},
    "garch_norm": {"alpha": (0.01, 0.3, False, 0.1), "persistence": (0.6, 0.995, False, 0.95)},
    "garch_t": {"alpha": (0.01, 0.3, False, 0.1), "df": (2.5, 30.0, False, 5.0), "persistence": (0.6, 0.995, False, 0.95)},
    "block_bootstrap": {"block": (2.0, 200.0, True, 20.0)},
    "gaussian": {},
    "iid_bootstrap": {},
}


def volatility_paths(innovations: DataFrame) -> DataFrame:
    """candidate, seed, i, r of GARCH paths of unit variance over innovations(candidate, seed, t, e, alpha, beta), a candidate in a task."""

    def advance(rows: pd.DataFrame) -> pd.DataFrame:
        e = rows.pivot(index="t", columns="seed", values="e").sort_index()
        alpha, beta = float(rows.alpha.iloc[0]), float(rows.beta.iloc[0])
        omega = 1 - alpha - beta
        out, s2 = np.empty(e.shape), np.ones(e.shape[1])
        for k, now in enumerate(e.to_numpy()):
            out[k] = np.sqrt(s2) * now
            s2 = omega + alpha * out[k] ** 2 + beta * s2
        made = pd.DataFrame(out, index=e.index, columns=e.columns).unstack().rename("r").reset_index()
        made.insert(0, "candidate", rows.candidate.iloc[0])
        return made.rename(columns={"t": "i"})[["candidate", "seed", "i", "r"]]

    return innovations.groupBy("candidate").applyInPandas(advance, "candidate string, seed long, i long, r double").where("i >= 0")


def paths(candidates: DataFrame, pool: DataFrame, seeds: int, first_seed: int = 0, n: int = 1000, key: int = generators.SEED) -> DataFrame:
    """candidate, seed, i, r of candidates(candidate, model, params): `seeds` paths each, the same random numbers for all candidates of
    a model, so that losses differ by parameters alone. pool(g, r): the returns that bootstraps draw from."""
    seeded = candidates.withColumn("seed", F.explode(F.sequence(F.lit(first_seed), F.lit(first_seed + seeds - 1)).cast("array<long>")))
    p = lambda name: F.col("params")[name]
    spread = lambda model, first=0: seeded.where(F.col("model") == model).withColumn("t", F.explode(F.sequence(F.lit(first), F.lit(n - 1)).cast("array<long>")))
    random = lambda model: (key, model, F.col("seed"), F.col("t"))
    named = lambda df: df.select("candidate", "seed", F.col("t").alias("i"), "r")
    out = named(spread("gaussian").withColumn("r", keyed.normal(*random("gaussian"))))
    out = out.unionByName(named(spread("student_t").withColumn("r", keyed.student(p("df"), *random("student_t")))))
    for model in ("garch_norm", "garch_t"):
        e = keyed.normal(*random(model)) if model == "garch_norm" else keyed.student(p("df"), *random(model))
        rows = spread(model, -generators.BURN).select("candidate", "seed", "t", e.alias("e"), p("alpha").alias("alpha"), F.greatest(p("persistence") - p("alpha"), F.lit(0.0)).alias("beta"))
        out = out.unionByName(volatility_paths(rows))
    size = F.broadcast(pool.agg(F.count("*").alias("size")))
    own = spread("iid_bootstrap").join(size).withColumn("g", keyed.index(F.col("size"), *random("iid_bootstrap")))  # one row
    block = p("block").cast("long")
    begin = keyed.index(F.col("size") - block, key, "block_bootstrap", F.col("seed"), F.floor(F.col("t") / block))
    blocks = spread("block_bootstrap").join(size).where(F.col("size") > block).withColumn("g", begin + F.col("t") % block)  # one row
    columns = ["candidate", "seed", "t", "g"]
    return out.unionByName(named(own.select(columns).unionByName(blocks.select(columns)).join(pool, "g")))


def evaluated(pool: DataFrame, target: DataFrame, seeds: int, drift_range: tuple | None = None, first_seed: int = 0, n: int = 1000) -> Callable[[DataFrame], DataFrame]:
    """An evaluation for `search`: medians over the seeds' statistics against target(stat, target, scale), behind all gates."""
    return lambda candidates: calibration.search(stored(paths(candidates, pool, seeds, first_seed, n), "paths"), target, seeds, drift_range)


def held_out(found: DataFrame, pool: DataFrame, target: DataFrame, seeds: int = 100, first_seed: int = 1000, n: int = 1000) -> DataFrame:
    """model, stat, median, lo, hi, target, z of the best points on seeds that the search hasn't used."""
    candidates = found.select(F.col("model").alias("candidate"), "model", "params")
    facts = battery.evaluate(stored(paths(candidates, pool, seeds, first_seed, n), "paths"), ("candidate", "seed"))
    long = battery.unpivoted(facts, ("candidate", "seed")).withColumnRenamed("candidate", "model")
    return reports.model_stats(long, target)
