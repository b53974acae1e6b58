"""Fifteen statistics of a window of returns. Undefined values, infinite ones included, are null.

A window's rows meet once, by its key, as an array in order: a window is of bounded length, by default 1000 rows. Lags, ranks
and blocks are functions of that array, so no row is multiplied by lags or scales, sorted again or shuffled again. Sums of
products over lags, 80 for each window, are taken in Arrow batches, many windows at once; all else are Spark's functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("series_id", "start")
DECAY_LAGS, LJUNG_LAGS, LEVERAGE_LAGS, SCALES = 50, 20, 5, (1, 2, 5, 10, 20)
STATS = (
    "excess_kurtosis", "hill_right", "hill_left", "gain_loss_asymmetry", "acf_return_1", "acf_abs_1", "acf_abs_20", "acf_abs_decay",
    "ljung_box_sq", "aggregational_gaussianity", "leverage", "vol_of_vol", "multiscaling", "variance_ratio_20", "drift",
)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda v, w: v * w))


def collected(windows: DataFrame, key=KEY) -> DataFrame:
    """key, n, r (an array by i) and moments of windows(key, i, r).

    The number of partitions is given, as windows are small and the work on them isn't: joined partitions would leave cores idle.
    """
    r = F.col("r")
    rows = windows.select(*key, "i", "r").repartition(int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    moments = [F.avg(r).alias("mean"), F.stddev_pop(r).alias("spread"), F.kurtosis(r).alias("excess_kurtosis"), F.skewness(r).alias("gain_loss_asymmetry"), F.avg(F.abs(r)).alias("mean_a"), F.avg(r * r).alias("mean_q")]
    out = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "r"))).alias("rows"), *moments)
    return out.withColumn("r", F.transform("rows", lambda x: x["r"])).withColumn("n", F.size("rows")).drop("rows")


def tails(rows: DataFrame) -> DataFrame:
    """Adds gains and losses (as positive numbers), the largest first."""
    rows = rows.withColumn("right", F.sort_array(F.filter("r", lambda v: v > 0), False))
    return rows.withColumn("left", F.sort_array(F.transform(F.filter("r", lambda v: v < 0), lambda v: -v), False))


def hill(side: str, frac: float) -> Column:
    """The tail index: the inverse mean log excess of the k largest over the one after them."""
    values, n = F.col(side), F.size(side)
    k = F.greatest(F.floor(n * F.lit(frac)).cast("int"), F.lit(10))
    mean = total(F.transform(F.slice(values, F.lit(1), k), F.ln)) / k - F.ln(F.get(values, k))
    return F.when((n > k) & (mean > 1e-12), F.try_divide(F.lit(1.0), mean))


def hill_sweep(windows: DataFrame, fracs=(0.025, 0.05, 0.10), key=KEY) -> DataFrame:
    """key, side, frac, hill for both tails and several tail fractions."""
    cases = [F.struct(F.lit(side).alias("side"), F.lit(frac).alias("frac"), hill(side, frac).alias("hill")) for side in ("left", "right") for frac in fracs]
    return tails(collected(windows, key)).select(*key, F.explode(F.array(*cases)).alias("x")).select(*key, "x.*")


LAGGED = "acf_return_1 double, abs_acf array<double>, square_acf array<double>, leverages array<double>"


def autocorrelations(d: np.ndarray, lags: int) -> np.ndarray:
    """Of each row by lag from 1; NaN where all deviations are zero or the lag is as long as the window."""
    out = np.full((len(d), lags), np.nan)
    squares = (d * d).sum(axis=1)
    for k in range(1, min(lags, d.shape[1] - 1) + 1):
        out[:, k - 1] = np.einsum("ij,ij->i", d[:, k:], d[:, :-k]) / np.where(squares == 0, np.nan, squares)
    return out


def leverages(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Correlation of each row's returns with the sizes 1 to LEVERAGE_LAGS later; NaN where one side doesn't move."""
    out = np.full((len(x), LEVERAGE_LAGS), np.nan)
    for k in range(1, min(LEVERAGE_LAGS, x.shape[1] - 1) + 1):
        p, q = x[:, :-k], y[:, k:]
        m, sum_p, sum_q = p.shape[1], p.sum(axis=1), q.sum(axis=1)
        square = (m * (p * p).sum(axis=1) - sum_p * sum_p) * (m * (q * q).sum(axis=1) - sum_q * sum_q)
        moves = (p.min(axis=1) < p.max(axis=1)) & (q.min(axis=1) < q.max(axis=1)) & (square > 0)
        out[:, k - 1] = (m * (p * q).sum(axis=1) - sum_p * sum_q) / np.sqrt(np.where(moves, square, np.nan))
    return out


def lag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds LAGGED to rows of arrays r and their means."""
    for batch in batches:
        column, n = batch.column("r"), batch.column("n").to_numpy()
        values, first = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        mean, mean_a, mean_q = (batch.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("mean", "mean_a", "mean_q"))
        made = [np.full((len(n), k), np.nan) for k in (1, DECAY_LAGS, LJUNG_LAGS, LEVERAGE_LAGS)]
        for size in np.unique(n):
            at = np.flatnonzero(n == size)
            r = values[first[at][:, None] + np.arange(size)]
            x, y, z = r - mean[at], np.abs(r) - mean_a[at], r * r - mean_q[at]
            for out, found in zip(made, (autocorrelations(x, 1), autocorrelations(y, DECAY_LAGS), autocorrelations(z, LJUNG_LAGS), leverages(x, y))):
                out[at] = found
        flat = [pa.array(m.ravel(), from_pandas=True) for m in made]
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * m.shape[1]), f) for m, f in zip(made[1:], flat[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns, flat[0], *lists], names=[*batch.schema.names, "acf_return_1", "abs_acf", "square_acf", "leverages"])


def dependence(rows: DataFrame) -> DataFrame:
    """Adds everything by lags."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    rows = rows.mapInArrow(lag_batches, f"{kinds}, {LAGGED}")
    n = F.col("n")
    box = total(F.transform("square_acf", lambda a, k: F.coalesce(a * a / (n - k - 1), F.lit(0.0))))
    decay = F.transform("abs_acf", lambda a, k: F.struct(F.ln(k + 1.0).alias("x"), F.when(a > 1e-6, F.ln(a)).alias("y")))
    moving = F.filter("leverages", lambda v: v.isNotNull())
    return rows.withColumns({
        "acf_abs_1": F.col("abs_acf")[0], "acf_abs_20": F.col("abs_acf")[19], "acf_abs_decay": slope(decay, 10),
        "leverage": F.try_divide(total(moving), F.nullif(F.size(moving), F.lit(0))), "ljung_box_sq": F.when(n > LJUNG_LAGS, F.ln(n * (n + 2) * box + 1e-12)),
    })


def slope(points: Column, least: int) -> Column:
    """Least squares of y on x over an array of points with known y; null for fewer than `least`."""
    known = F.filter(points, lambda p: p["y"].isNotNull())
    n = F.size(known)
    total = lambda f: F.aggregate(known, F.lit(0.0), lambda s, p: s + f(p))
    top = n * total(lambda p: p["x"] * p["y"]) - total(lambda p: p["x"]) * total(lambda p: p["y"])
    low = n * total(lambda p: p["x"] * p["x"]) - total(lambda p: p["x"]) * total(lambda p: p["x"])
    return F.when(n >= least, F.try_divide(top, F.nullif(low, F.lit(0.0))))


def in_blocks(size: int, of, array: str = "r") -> Column:
    """of(first place) for each whole block of neighbours in an array, in order; an empty array where there is none."""
    count = F.floor(F.size(array) / size).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda b: of(b * size))


def sums(size: int, array: str = "r") -> Column:
    """Sums of whole blocks of neighbours, by access to each place: a slice would copy the array."""
    return in_blocks(size, lambda first: sum((F.get(array, first + j) for j in range(1, size)), F.get(array, first)), array)


def central(array: str, power: int) -> Column:
    """The mean of a power of an array's deviations from its mean, null for an empty one."""
    mean = F.col(f"{array}_mean")
    raised = lambda d: d * d if power == 2 else d * d * d * d
    return F.try_divide(F.aggregate(array, F.lit(0.0), lambda s, v: s + raised(v - mean)), F.size(array))


def log_spread(first: Column) -> Column:
    """Log of the deviation within the 21 returns from a place, null where they don't move."""
    block = F.slice("r", first + 1, F.lit(21))
    square = dot(block, block) / 21 - F.pow(total(block) / 21, 2)
    return F.when((F.array_min(block) < F.array_max(block)) & (square > 0), F.ln(square) / 2)


def blocks(rows: DataFrame) -> DataFrame:
    """Adds everything from sums over neighbouring blocks; what is left over at the end isn't used."""
    rows = rows.withColumns({"block1": F.col("r"), "block2": sums(2), "block5": sums(5), "log21": F.filter(in_blocks(21, log_spread), lambda v: v.isNotNull())})
    rows = rows.withColumn("block10", sums(2, "block5")).withColumn("block20", sums(2, "block10"))
    rows = rows.withColumns({f"{c}_mean": F.try_divide(total(F.col(c)), F.size(c)) for c in ("block5", "block20", "log21")})
    used = F.size("block20") * 20
    head = F.slice("r", F.lit(1), used)
    flat = dot(head, head) / used - F.pow(total(F.col("block20")) / used, 2)  # variance of the rows that the blocks of 20 cover
    rows = rows.withColumns({"m4": central("block5", 4), "m2": central("block5", 2), "flat": F.when(used >= 200, flat)})

    def fits(of) -> Column:
        means = [(s, F.try_divide(total(F.transform(f"block{s}", of)), F.size(f"block{s}"))) for s in SCALES]
        return F.array(*(F.struct(F.ln(F.lit(float(s))).alias("x"), F.when((F.size(f"block{s}") >= 30) & (m > 0), F.ln(m)).alias("y")) for s, m in means))

    rows = rows.withColumns({"fit1": fits(F.abs), "fit2": fits(lambda v: v * v)})
    kurtosis = F.try_divide(F.col("m4"), F.nullif(F.col("m2") * F.col("m2"), F.lit(0.0))) - 3
    return rows.withColumns({
        "aggregational_gaussianity": F.col("excess_kurtosis") - F.when(F.size("block5") >= 50, kurtosis),
        "vol_of_vol": F.when(F.size("log21") >= 10, F.sqrt(central("log21", 2))),
        "variance_ratio_20": F.when(F.col("flat") > 0, F.try_divide(central("block20", 2), 20 * F.col("flat"))),
        "multiscaling": slope(F.col("fit1"), len(SCALES)) - slope(F.col("fit2"), len(SCALES)) / 2,
    })


def evaluate(windows: DataFrame, key=KEY) -> DataFrame:
    """key and the fifteen statistics of every window of windows(key, i, r)."""
    rows = blocks(tails(dependence(collected(windows, key))))
    rows = rows.withColumns({"hill_right": hill("right", 0.05), "hill_left": hill("left", 0.05), "drift": F.try_divide("mean", F.nullif(F.col("spread"), F.lit(0.0)))})
    return rows.select(*key, *(finite(F.col(s)).alias(s) for s in STATS))


def unpivoted(facts: DataFrame, key=KEY, stats=STATS) -> DataFrame:
    """key, stat, value."""
    return facts.unpivot(list(key), list(stats), "stat", "value")


def summary(long: DataFrame) -> DataFrame:
    """stat, n, median, p2.5, p97.5 and deviation over the windows where it is defined."""
    at = lambda p: F.percentile("value", F.lit(p))
    return long.groupBy("stat").agg(F.count("value").alias("n"), at(0.5).alias("median"), at(0.025).alias("lo"), at(0.975).alias("hi"), F.stddev_pop("value").alias("scale"))
