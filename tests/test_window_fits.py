import numpy as np

from driftglass.operators import fitting


def likelihood(r, p):
    s = fitting.variances(r * r, float(r.var()), *p)
    return float((np.log(s) + r * r / s).sum())


def test_windows_fitted_together_are_fitted_as_each_alone():
    g = np.random.default_rng(3)
    for size, n in ((400, 3), (97, 2)):
        e, r, s = g.standard_t(6, (size, n)), np.empty((size, n)), np.ones(n)
        for t in range(size):
            r[t] = np.sqrt(s) * e[t]
            s = 0.05 + 0.12 * r[t] ** 2 + 0.8 * s
        together, tails = fitting.fit_volatilities(r), fitting.fit_t_dfs(r)
        for k in range(n):
            alone = fitting.fit_volatility(r[:, k])
            assert likelihood(r[:, k], together[k]) <= likelihood(r[:, k], alone) + 1e-6
            assert abs(tails[k] - fitting.fit_t_df(r[:, k])) < 1e-3


def test_windows_of_a_table_in_any_mixture(spark):
    g = np.random.default_rng(4)
    windows = {("x", 0): g.normal(size=96), ("x", 5): np.zeros(20), ("y", 0): g.normal(size=96), ("y", 7): g.normal(size=1)}
    rows = [(*k, i, float(v)) for k, r in windows.items() for i, v in enumerate(r)]
    got = {(r.series_id, r.start): r for r in fitting.fit_windows(spark.createDataFrame(rows, "series_id string, start long, i long, r double").repartition(3)).collect()}
    assert set(got) == set(windows)
    for k, r in windows.items():
        alone = fitting.fit_volatility(r)
        if len(r) > 50:
            assert likelihood(r, got[k][2:5]) <= likelihood(r, alone) + 1e-6 and abs(got[k].t_df - fitting.fit_t_df(r)) < 1e-3
        else:
            assert got[k][2:5] == alone and 2.5 <= got[k].t_df <= 30  # a window of zeros ended the query before
