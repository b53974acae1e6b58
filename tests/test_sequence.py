import numpy as np
import pytest
from pyspark.sql import functions as F

from driftglass.operators import sequence


def longest(values):
    best = run = 0
    for v in values:
        run = run + 1 if v is not None and abs(v) < 1e-12 else 0
        best = max(best, run)
    return best


@pytest.mark.parametrize("part", [3, 7, sequence.PART])
def test_zero_runs_across_parts(spark, part):
    g = np.random.default_rng(1)
    data = {k: [None if g.random() < 0.02 else 0.0 if g.random() < 0.8 else 1.0 for _ in range(int(n))] for k, n in enumerate((1, 2, 6, 20, 90, 200))}
    data |= {10: [0.0] * 40, 11: [1.0] * 40, 12: [1.0] + [0.0] * 39, 13: [0.0] * 39 + [1.0], 14: [None] * 5}
    rows = [(k, 1000 + 2 * i, v) for k, vs in data.items() for i, v in enumerate(vs)]  # numbers with gaps, from anywhere
    df = spark.createDataFrame(rows, "k long, i long, r double").repartition(4)
    got = {x.k: x.longest for x in sequence.zero_runs(df, ("k",), part=part).collect()}
    assert got == {k: longest(vs) for k, vs in data.items()}
    assert sequence.zero_runs(df.limit(0), ("k",)).count() == 0


@pytest.mark.parametrize("part", [5, sequence.PART])
def test_trailing_slices(spark, part):
    g = np.random.default_rng(2)
    r = g.normal(5, 1, 60)
    m = [int(x) for x in g.integers(-1, 80, 60)]
    df = spark.createDataFrame([("a", i + 7, float(v), n, 1.0) for i, (v, n) in enumerate(zip(r, m))] + [("b", 0, 2.0, 3, 1.0)], "series_id string, i long, r double, m long, s1 double").repartition(3)
    got = {(x.series_id, x.i): x for x in sequence.trailing_slices(df.drop("s1"), "m", part=part).collect()}
    assert len(got) == 61 and (got["b", 0].mean, got["b", 0].variance) == (2.0, 0.0)
    for i, n in enumerate(m):
        x, held = got["a", i + 7], r[max(0, i + 1 - n) : i + 1]
        if n < 1:
            assert x.mean is None and x.variance is None
        else:
            assert (x.mean, x.variance) == (pytest.approx(held.mean()), pytest.approx(held.var(), abs=1e-12))


def test_paths_over_parts(spark):
    r = np.random.default_rng(3).normal(size=50)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(r)], "series_id string, i long, r double").repartition(3)
    got = {x.i: x.path for x in sequence.cumulative_paths(df, part=6).collect()}
    assert [got[i] for i in range(50)] == pytest.approx(np.cumsum(r))


def test_percentiles_are_exact(spark):
    g = np.random.default_rng(4)
    data = {"a": g.normal(size=700).round(2).tolist(), "b": [1.0], "c": [2.0, 5.0], "d": [3.0] * 40 + [None] * 5}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("none", None)], "k string, v double").repartition(3)
    shares = [0.0, 0.01, 0.3, 0.5, 0.975, 1.0]
    got = {(r.k, r.share): r.value for r in sequence.percentiles(df, ["k"], "v", shares).collect()}
    assert got == pytest.approx({(k, p): float(np.percentile([v for v in vs if v is not None], 100 * p)) for k, vs in data.items() for p in shares})


@pytest.mark.parametrize("part", [12, sequence.PART])
def test_smoothed_autocorrelations(spark, part):
    g = np.random.default_rng(5)
    data = {"a": g.normal(size=83), "b": g.normal(size=12), "flat": np.ones(30)}
    df = spark.createDataFrame([(k, i, float(v)) for k, r in data.items() for i, v in enumerate(r)], "series_id string, i long, r double").repartition(3)
    got = {(x.series_id, x.lag): x.acf for x in sequence.smoothed_autocorrelations(df, [1, 4, 9], F.abs("r"), part=part).collect()}

    def acf(r, k):
        x = np.abs(r) - np.abs(r).mean()
        return (x[k:] * x[:-k]).sum() / (x * x).sum()

    for k, r in data.items():
        for lag in (1, 4, 9):
            near = [j for j in (lag - 1, lag, lag + 1) if j]
            assert got[k, lag] == (None if k == "flat" else pytest.approx(np.mean([acf(r, j) for j in near])))
