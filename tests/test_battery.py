import math

import numpy as np
import pytest

from driftglass.operators import battery
from driftglass.operators.windows import sliding, tail

rng = np.random.default_rng(8)


def frame(spark, named):
    rows = [(k, 0, i, float(x)) for k, xs in named.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "series_id string, start long, i long, r double")


def acf(x, k):
    m = x - x.mean()
    return (m[k:] * m[:-k]).sum() / (m * m).sum()


def expected(x):
    n, a = len(x), np.abs(x)
    z = (x - x.mean()) / x.std()
    block = lambda s: x[: n // s * s].reshape(-1, s).sum(axis=1)
    kurt = lambda v: (((v - v.mean()) / v.std()) ** 4).mean() - 3

    def tail_index(v):
        v = np.sort(v)[::-1]
        k = max(int(len(v) * 0.05), 10)
        return 1 / np.log(v[:k] / v[k]).mean()

    lags = [(math.log(k), math.log(acf(a, k))) for k in range(1, 51) if acf(a, k) > 1e-6]
    zeta = lambda q: np.polyfit(np.log([1, 2, 5, 10, 20]), [np.log((np.abs(block(s)) ** q).mean()) for s in (1, 2, 5, 10, 20)], 1)[0]
    sd = x[: n // 21 * 21].reshape(-1, 21).std(axis=1)
    return {
        "excess_kurtosis": kurt(x), "hill_right": tail_index(x[x > 0]), "hill_left": tail_index(-x[x < 0]), "gain_loss_asymmetry": (z**3).mean(),
        "acf_return_1": acf(x, 1), "acf_abs_1": acf(a, 1), "acf_abs_20": acf(a, 20), "acf_abs_decay": np.polyfit(*zip(*lags), 1)[0] if len(lags) >= 10 else None,
        "ljung_box_sq": math.log(n * (n + 2) * sum(acf(x * x, k) ** 2 / (n - k) for k in range(1, 21)) + 1e-12), "aggregational_gaussianity": kurt(x) - kurt(block(5)),
        "leverage": np.mean([np.corrcoef(x[:-k], a[k:])[0, 1] for k in range(1, 6)]), "vol_of_vol": np.log(sd).std(), "multiscaling": zeta(1) - zeta(2) / 2,
        "variance_ratio_20": block(20).var() / 20 / x[: n // 20 * 20].var(), "drift": x.mean() / x.std(),
    }


def test_matches_numpy_and_ignores_scale(spark):
    xs = {"t": rng.standard_t(4, 1000), "n": rng.normal(0.1, 1, 777), "garch": rng.normal(size=900) * np.exp(np.cumsum(rng.normal(0, 0.1, 900)) * 0.3)}
    xs["scaled"] = 37.5 * xs["t"]
    got = {r.series_id: r for r in battery.evaluate(frame(spark, xs)).collect()}
    for name, x in xs.items():
        for stat, want in expected(x).items():
            assert (got[name][stat] is None) == (want is None), (name, stat)
            assert want is None or got[name][stat] == pytest.approx(want, rel=1e-7, abs=1e-9), (name, stat)


def test_degenerate_windows(spark):
    xs = {"flip": np.tile([1.0, -1.0], 500), "flat": np.full(1000, 0.5)}
    xs |= {f"n{n}": rng.normal(size=n) for n in (199, 200, 209, 210, 249, 250, 599, 600)}
    got = {r.series_id: r for r in battery.evaluate(frame(spark, xs)).collect()}
    flip = got["flip"]
    assert (flip.excess_kurtosis, flip.gain_loss_asymmetry, flip.drift, flip.variance_ratio_20) == pytest.approx((-2, 0, 0, 0), abs=1e-9)
    assert flip.acf_return_1 == pytest.approx(-0.999)
    assert flip.acf_abs_1 is flip.acf_abs_20 is flip.leverage is flip.hill_right is flip.hill_left is flip.multiscaling is None
    assert all(got["flat"][s] is None for s in ("excess_kurtosis", "gain_loss_asymmetry", "drift", "acf_return_1", "variance_ratio_20"))
    defined = lambda n, s: got[f"n{n}"][s] is not None
    for stat, least in (("variance_ratio_20", 200), ("vol_of_vol", 210), ("aggregational_gaussianity", 250), ("multiscaling", 600)):
        assert defined(least, stat) and not defined(least - 1, stat)


def test_tails_need_more_than_ten(spark):
    xs = {"ten": np.append(np.arange(1, 11.0), -np.arange(1, 60.0)), "eleven": np.append(np.arange(1, 12.0), -np.arange(1, 60.0))}
    got = {r.series_id: r for r in battery.evaluate(frame(spark, xs)).collect()}
    assert got["ten"].hill_right is None and got["eleven"].hill_right is not None


def test_windows_are_full_and_slide(spark):
    rows = frame(spark, {"a": np.arange(27.0), "b": np.arange(9.0)}).drop("start")
    got = sorted(map(tuple, sliding(rows, 10, 5).groupBy("series_id", "start").agg({"i": "min", "*": "count", "r": "max"}).select("series_id", "start", "min(i)", "count(1)", "max(r)").collect()))
    assert got == [("a", s, s, 10, s + 9.0) for s in (0, 5, 10, 15)]
    assert sorted((r.series_id, r.start, r.i) for r in tail(rows, 3).collect())[:3] == [("a", 24, 24), ("a", 24, 25), ("a", 24, 26)]
