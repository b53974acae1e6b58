"""Reference series of known structure, drawn by keyed random numbers: any run can be made anywhere, in any order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftglass.functions import keyed

SEED, BURN, BLOCK, RUNS_AT_ONCE = 20260802, 500, 20, 32


def steps(spark: SparkSession, runs: int, n: int, first: int = 0) -> DataFrame:
    """run, t for t from first to n - 1."""
    size = n - first
    return spark.range(runs * size).select(F.floor(F.col("id") / size).cast("long").alias("run"), (F.col("id") % size + first).cast("long").alias("t"))


def pooled(rows: DataFrame) -> DataFrame:
    """g, r: all returns end to end, series by series."""
    sizes = rows.groupBy("series_id").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("series_id").rowsBetween(Window.unboundedPreceding, -1))  # a row a series
    sizes = sizes.select("series_id", F.coalesce(before, F.lit(0)).alias("offset"))
    return rows.join(sizes, "series_id").select((F.col("offset") + F.col("i")).cast("long").alias("g"), "r")


def named(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.lit(name).alias("generator"), "run", F.col("t").alias("i"), "r")


def gaussian(spark: SparkSession, runs: int, n: int, seed: int = SEED) -> DataFrame:
    return named(steps(spark, runs, n).withColumn("r", keyed.normal(seed, "gaussian", F.col("run"), F.col("t"))), "gaussian")


def student_t(spark: SparkSession, runs: int, n: int, df: float, seed: int = SEED) -> DataFrame:
    return named(steps(spark, runs, n).withColumn("r", keyed.student(df, seed, "student_t", F.col("run"), F.col("t"))), "student_t")


def iid_bootstrap(pool: DataFrame, runs: int, n: int, seed: int = SEED) -> DataFrame:
    """Returns drawn one by one from pool(g, r), with replacement."""
    size = F.broadcast(pool.agg(F.count("*").alias("size")))
    rows = steps(pool.sparkSession, runs, n).join(size)  # one row
    rows = rows.withColumn("g", keyed.index(F.col("size"), seed, "iid_bootstrap", F.col("run"), F.col("t")))
    return named(rows.join(pool, "g"), "iid_bootstrap")


def block_bootstrap(pool: DataFrame, runs: int, n: int, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Stretches of `block` neighbours, which may straddle series. A stretch lies in two pieces of the pool at most, so
    stretches meet pieces, not rows."""
    size = F.broadcast(pool.agg(F.count("*").alias("size")))
    rows = steps(pool.sparkSession, runs, -(-n // block)).join(size).where(F.col("size") > block).withColumnRenamed("t", "k")  # one row
    rows = rows.withColumn("start", keyed.index(F.col("size") - block, seed, "block_bootstrap", F.col("run"), F.col("k")))
    rows = rows.withColumn("piece", F.explode(F.array(F.floor(F.col("start") / block), F.floor(F.col("start") / block) + 1)))
    pieces = pool.groupBy(F.floor(F.col("g") / block).alias("piece")).agg(F.collect_list(F.struct("g", "r")).alias("held"))
    rows = rows.join(pieces, "piece").select("run", "k", "start", F.explode("held").alias("x"))
    rows = rows.withColumn("t", F.col("k") * block + F.col("x.g") - F.col("start")).where((F.col("x.g") >= F.col("start")) & (F.col("x.g") < F.col("start") + block) & (F.col("t") < n))
    return named(rows.select("run", "t", F.col("x.r").alias("r")), "block_bootstrap")


def volatility_paths(innovations: DataFrame, omega: float, alpha: float, beta: float) -> DataFrame:
    """run, t, r of GARCH(1,1) paths over innovations(run, t, e); RUNS_AT_ONCE paths advance together in a task."""

    def advance(rows: pd.DataFrame) -> pd.DataFrame:
        e = rows.pivot(index="t", columns="run", values="e").sort_index()
        out, s2 = np.empty(e.shape), np.full(e.shape[1], omega / max(1e-8, 1 - alpha - beta))
        for k, step in enumerate(e.to_numpy()):
            out[k] = np.sqrt(s2) * step
            s2 = omega + alpha * out[k] ** 2 + beta * s2
        return pd.DataFrame(out, index=e.index, columns=e.columns).unstack().rename("r").reset_index()[["run", "t", "r"]]

    return innovations.groupBy(F.floor(F.col("run") / RUNS_AT_ONCE)).applyInPandas(advance, "run long, t long, r double")


def garch(spark: SparkSession, runs: int, n: int, omega: float, alpha: float, beta: float, df: float | None = None, seed: int = SEED) -> DataFrame:
    """GARCH paths after a burn-in, with normal innovations, or Student's t for a df."""
    name = "garch_norm" if df is None else "garch_t"
    key = (seed, name, F.col("run"), F.col("t"))
    e = keyed.normal(*key) if df is None else keyed.student(df, *key)
    rows = volatility_paths(steps(spark, runs, n, -BURN).withColumn("e", e), omega, alpha, beta)
    return named(rows.where("t >= 0"), name)


def all_generators(pool: DataFrame, context: dict, runs: int, n: int, names: tuple[str, ...] | None = None) -> DataFrame:
    """The six reference generators, or those named; context: t_df, omega, alpha, beta."""
    spark, g = pool.sparkSession, (context["omega"], context["alpha"], context["beta"])
    made = {
        "gaussian": lambda: gaussian(spark, runs, n), "student_t": lambda: student_t(spark, runs, n, context["t_df"]),
        "iid_bootstrap": lambda: iid_bootstrap(pool, runs, n), "block_bootstrap": lambda: block_bootstrap(pool, runs, n),
        "garch_norm": lambda: garch(spark, runs, n, *g), "garch_t": lambda: garch(spark, runs, n, *g, df=context["t_df"]),
    }
    parts = [made[name]() for name in names or made]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
