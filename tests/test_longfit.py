import numpy as np
import pytest

from driftglass.operators import fitting, longfit


def series_of(spark, **named):
    rows = [(k, i, float(v)) for k, r in named.items() for i, v in enumerate(r)]
    return spark.createDataFrame(rows, "series_id string, i long, r double").repartition(5)


def clustered(seed, n, omega=0.05, alpha=0.12, beta=0.8, df=None):
    g, s, out = np.random.default_rng(seed), omega / (1 - alpha - beta), []
    for _ in range(n):
        e = g.normal() if df is None else g.standard_t(df) / np.sqrt(df / (df - 2))
        out.append(np.sqrt(s) * e)
        s = omega + alpha * out[-1] ** 2 + beta * s
    return np.array(out)


def sequential(r, omega, alpha, beta):
    s, f = r.var(), 0.0
    for x in r:
        f += np.log(s) + x * x / s
        s = omega + alpha * x * x + beta * s
    return f


POINTS = [(0.05, 0.1, 0.8), (0.2, 0.0, 0.7), (0.3, 0.4, 0.0), (1e-4, 0.05, 0.9489)]


@pytest.mark.parametrize("chunk", [97, 1000, longfit.CHUNK])
def test_likelihood_of_parts_is_that_of_the_whole(spark, chunk):
    data = {"x": clustered(1, 2500), "y": clustered(2, 97), "z": clustered(3, 98)}
    got = {(r.series_id, r.point): r.f for r in longfit.likelihood_table(series_of(spark, **data), POINTS, chunk=chunk).collect()}
    assert len(got) == 12
    for (k, j), f in got.items():
        assert f == pytest.approx(sequential(data[k], *POINTS[j]), rel=1e-9)


def test_gradient_matches_differences(spark):
    r = clustered(4, 700)
    parts = longfit.chunked(series_of(spark, x=r), chunk=64)
    p, e = np.array([0.06, 0.1, 0.75]), 1e-6
    _, g, h = longfit.volatility_at(parts)({"x": p[None]})["x", 0]
    want = [(sequential(r, *(p + e * d)) - sequential(r, *(p - e * d))) / (2 * e) for d in np.eye(3)]
    assert g == pytest.approx(want, rel=1e-4)
    assert (np.linalg.eigvalsh(h) > 0).all()


def test_fits_reach_the_sequential_optimum(spark):
    data = {"garch": clustered(5, 3000), "heavy": clustered(6, 1500, df=5), "differenced": np.diff(np.random.default_rng(8).normal(size=1501))}
    fits = {r.series_id: r for r in longfit.fit_series(series_of(spark, **data), chunk=1024).collect()}
    for k, r in data.items():
        own = fits[k]
        best = sequential(r, *fitting.fit_volatility(r))
        assert sequential(r, own.omega, own.alpha, own.beta) <= best + 1e-5, k
        df = fitting.fit_t_df(r)
        assert own.t_df == pytest.approx(df, rel=2e-3) or (own.t_df > 25 and df > 25)
    assert (fits["garch"].alpha, fits["garch"].beta) == pytest.approx((0.12, 0.8), abs=0.06)


def test_series_without_spread_and_empty_tables(spark):
    got = {r.series_id: (r.omega, r.alpha, r.beta, r.t_df) for r in longfit.fit_series(series_of(spark, flat=[0.0] * 20, one=[1.5])).collect()}
    assert got == {"flat": (0.0, 0.08, 0.9, None), "one": (0.0, 0.08, 0.9, None)}
    assert longfit.fit_series(spark.createDataFrame([], "series_id string, i long, r double")).count() == 0
