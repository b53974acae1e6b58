import hashlib

import numpy as np
import pytest

from driftglass.operators import calibration, fitting, generators, robustness, sequence, twosample
from driftglass.sources import results, series


def samples(spark, groups):
    rows = [(g, side, k, float(v)) for g, sides in groups.items() for side, vs in zip("ab", sides) for k, v in enumerate(vs)]
    return spark.createDataFrame(rows, "g string, side string, k long, value double")


def test_known_comparisons(spark):
    groups = {"apart": ([1, 2, 3, 4, 5], [6, 7, 8, 9, 10]), "same": ([1, 2, 3, 4, 5],) * 2, "ties": ([1, 1, 1, 2, 2], [1, 2, 2, 2, 2]), "few": ([1, 2, 3, 4], [1, 2, 3, 4, 5])}
    got = {r.g: (r.auc, r.power, r.ks) for r in twosample.compared(samples(spark, groups), ["g"]).collect()}
    assert got["apart"] == (1, 1, 1) and got["same"] == (0.5, 0, 0) and got["few"] == (None, None, None)
    assert got["ties"] == pytest.approx((0.7, 0.4, 0.4))


def test_large_samples_match_numpy(spark):
    r = np.random.default_rng(3)
    a, b = r.normal(size=900).round(2), (r.normal(size=700) + 0.2).round(2)
    got = twosample.compared(samples(spark, {"x": (a, b)}), ["g"]).first()
    pooled = np.unique(np.append(a, b))
    ks = np.abs((a[:, None] <= pooled).mean(axis=0) - (b[:, None] <= pooled).mean(axis=0)).max()
    auc = ((b > a[:, None]) + 0.5 * (b == a[:, None])).mean()
    assert (got.ks, got.auc) == (pytest.approx(ks), pytest.approx(auc))


def test_permutations_and_bootstrap(spark):
    r = np.random.default_rng(4)
    rows = samples(spark, {"same": ([1, 2, 3, 4, 5],) * 2, "apart": (r.normal(size=40), r.normal(size=40) + 3), "null": (r.normal(size=40), r.normal(size=40))})
    got = {x.g: x for x in twosample.permutation_test(rows, ["g"], ["k"], 99, 1).collect()}
    assert got["same"].pvalue == 1 and got["apart"].pvalue == 0.01 and got["null"].pvalue > 0.01 and 0 < got["null"].null95 < 0.5
    ci = {x.g: x for x in twosample.bootstrap_power(rows, ["g"], ["k"], 50, 1).collect()}
    assert 0.9 < ci["apart"].ci_lo <= ci["apart"].ci_hi <= 1 and ci["null"].ci_lo < 0.3
    for f in (twosample.permutation_test, twosample.bootstrap_power):
        both = [sorted((tuple(round(v, 12) if isinstance(v, float) else v for v in x) for x in f(rows, ["g"], ["k"], 30, 1, most).collect()), key=str) for most in (1000, 20, 0)]
        assert both[0] == both[1] == both[2]


def test_permutations_match_plain_python(spark):
    r = np.random.default_rng(12)
    a, b = r.normal(size=9).round(1), r.normal(0.4, 1, 7).round(1)
    rows = [("a", k, v) for k, v in enumerate(a)] + [("b", k, v) for k, v in enumerate(b)]

    def gap(labels):
        at = sorted({v for _, _, v in rows})
        share = lambda s: [sum(v <= x for (_, _, v), y in zip(rows, labels) if y == s) / labels.count(s) for x in at]
        return max(abs(p - q) for p, q in zip(share("a"), share("b")))

    found, null = gap([s for s, _, _ in rows]), []
    for perm in range(40):
        order = sorted(range(len(rows)), key=lambda k: hashlib.md5(f"3|perm|{perm}|{rows[k][0]}|{rows[k][1]}".encode()).hexdigest())
        null.append(gap(["a" if order.index(k) < 9 else "b" for k in range(len(rows))]))
    got = twosample.permutation_test(samples(spark, {"g": (a, b)}), ["g"], ["k"], 40, 3).first()
    want = (found, (1 + sum(x >= found - 1e-12 for x in null)) / 41, np.percentile(null, 95))
    assert (got.ks, got.pvalue, got.null95) == pytest.approx(want)


def test_mid_ranks(spark):
    rows = spark.createDataFrame([("x", v, k) for k, v in enumerate([3.0, 1.0, 3.0, None, 2.0, 3.0])] + [("y", 5.0, 9)], "g string, value double, k int")
    got = {x.k: x["rank"] for x in sequence.mid_ranks(rows, ["g"]).collect()}
    assert got == {0: 4, 1: 1, 2: 4, 3: None, 4: 2, 5: 4, 9: 1}


def test_generators_have_their_moments(spark):
    g = generators.gaussian(spark, 20, 1000).toPandas().r
    t = generators.student_t(spark, 20, 1000, 5.0).toPandas().r
    assert abs(g.mean()) < 0.03 and abs(g.std() - 1) < 0.03 and abs(t.std() - 1) < 0.05 and t.kurt() > 1
    pool = spark.createDataFrame([(k, float(k)) for k in range(100)], "g long, r double")
    b = generators.block_bootstrap(pool, 3, 50).toPandas().sort_values(["run", "i"])
    inside = b[b.i % 20 != 0]
    assert ((inside.r.to_numpy() - b.r.shift().loc[inside.index].to_numpy()) == 1).all() and len(b) == 150
    assert set(generators.iid_bootstrap(pool, 2, 50).toPandas().r) <= set(range(100))


def test_fits_recover_parameters(spark):
    r = generators.garch(spark, 1, 4000, 0.05, 0.12, 0.8).toPandas().sort_values("i").r.to_numpy()
    omega, alpha, beta = fitting.fit_volatility(r)
    assert alpha == pytest.approx(0.12, abs=0.05) and beta == pytest.approx(0.8, abs=0.1) and 0 < omega < 0.15
    t = np.random.default_rng(5).standard_t(4, 5000)
    assert fitting.fit_t_df(t) == pytest.approx(4, abs=0.7)


def test_variances_follow_their_recursion():
    r = np.random.default_rng(8)
    for n, beta in ((1, 0.5), (127, 0.9), (128, 0.0), (129, 0.86), (1000, 0.93)):
        x, want = r.normal(size=n) ** 2, [0.7]
        for v in x[:-1]:
            want.append(0.02 + 0.1 * v + beta * want[-1])
        assert fitting.variances(x, 0.7, 0.02, 0.1, beta) == pytest.approx(np.array(want))


def test_gates(spark):
    r = np.random.default_rng(6)
    run = lambda n: np.concatenate([r.normal(size=300), np.zeros(n), r.normal(size=700)])
    paths = {0: r.normal(size=899), 1: np.zeros(1000), 2: np.append(r.normal(size=950), np.full(50, 0.1)), 3: run(50), 4: run(51), 5: np.append(r.normal(size=999), np.nan)}
    rows = spark.createDataFrame([(0, k, i, float(x)) for k, xs in paths.items() for i, x in enumerate(xs)], "candidate long, seed long, i long, r double")
    got = {x.seed: x.reason for x in calibration.gated(rows).collect()}
    assert got == {0: "short", 1: "constant", 2: "stopped", 3: None, 4: "zero run", 5: "not finite"}
    longest = {x.seed: x.longest for x in sequence.zero_runs(rows, ("candidate", "seed")).collect()}
    assert (longest[0], longest[3], longest[4]) == (0, 50, 51)


def test_search_gates_and_orders_candidates(spark):
    r = np.random.default_rng(9)
    rows = [(c, k, i, float(x)) for c, scale in (("calm", 0.0), ("wild", 3.0)) for k in range(6) for i, x in enumerate(r.normal(size=950) * np.exp(scale * 0.2 * r.normal(size=950)))]
    rows += [("flat", k, i, 0.5) for k in range(6) for i in range(950)] + [("few", 0, i, float(x)) for i, x in enumerate(r.normal(size=950))]
    rows += [("same", k, i, float(x)) for x_s in [r.normal(size=950)] for k in range(6) for i, x in enumerate(x_s)]
    paths = spark.createDataFrame(rows, "candidate string, seed long, i long, r double")
    target = spark.createDataFrame([(s, 0.0, 1.0) for s in calibration.FITTED], "stat string, target double, scale double")
    got = {x.candidate: (x.loss, x.reason) for x in calibration.search(paths, target, 6).collect()}
    assert got["calm"][0] < got["wild"][0] and got["flat"] == (None, "constant") and got["few"] == (None, "quorum") and got["same"] == (None, "deterministic")
    assert {x.candidate: x.reason for x in calibration.search(paths.where("candidate = 'calm'"), target, 6, (5.0, 6.0)).collect()} == {"calm": "drift"}
    sums = {tuple(x) for x in calibration.rejections(calibration.gated(paths)).collect()}
    assert sums == {("flat", "constant", 6)}
    weights = calibration.on_simplex(spark.createDataFrame([(1.0, 3.0), (0.0, 0.0)], "w_a double, w_b double"), ["w_a", "w_b"]).collect()
    assert [tuple(x) for x in weights] == [(0.25, 0.75), (None, None)]
    base = spark.createDataFrame([("m", "a", 0.0, 1.0), ("m", "b", 0.0, 1.0)], "model string, param string, lo double, hi double")
    assert {tuple(x) for x in calibration.overridden(base, base.where("param = 'b'").withColumn("hi", base.hi + 1)).collect()} == {("m", "a", 0.0, 1.0), ("m", "b", 0.0, 2.0)}
    long = spark.createDataFrame([("m", "s", k, float(k)) for k in range(5)], "model string, stat string, seed long, value double")
    assert [tuple(x) for x in calibration.hold_out(long, "model", "seed", 2).collect()] == [("m", "s", 0.5, 3.0)]


def test_published_digest(spark):
    closes = spark.createDataFrame([("x", 86400, 1.5), ("x", 0, 2.25), ("x", 172800, None)], "series_id string, ts long, close double")
    got = series.line_digests(series.parsed(series.as_payloads(closes))).first()
    assert (got.n, got.sha256) == (2, hashlib.sha256(b"0,2.250000\n86400,1.500000").hexdigest())


def test_effective_number(spark):
    rows = [("s", p, float(10 * p + k)) for p in range(5) for k in range(3)] + [("lone", p, float(p)) for p in range(5)]
    got = {r.stat: r for r in robustness.effective_n(spark.createDataFrame(rows, "stat string, start long, value double")).collect()}
    assert got["lone"].n_eff == 5 and got["lone"].deff == 1 and 2.9 < got["s"].deff <= 3


def test_payloads_resume_and_guard(spark, tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    (folder / "abc.json").write_text('{"chart": {"result": [{"timestamp": [0, 86400, 172800, 259200], "indicators": {"quote": [{"close": [1.0, null, 2.718281828459045, 7.38905609893065]}]}}]}}')
    prices = series.payloads(spark, str(folder))
    assert [(r.series_id, r.i, round(r.r, 9)) for r in series.returns(prices, standardised=False).orderBy("i").collect()] == [("abc", 0, 1.0), ("abc", 1, 1.0)]
    found = series.digests(prices)
    assert [r.ok for r in series.verified(found, found).collect()] == [True]
    with pytest.raises(series.NoSourceData):
        series.require_rows(prices.limit(0), "prices")
    done = spark.createDataFrame([("m1", 1)], "model string, loss int")
    results.save_part(done, str(tmp_path / "out"))
    results.save_part(spark.createDataFrame([("m2", 2)], "model string, loss int"), str(tmp_path / "out"))
    again = results.load(spark, str(tmp_path / "out"), "loss int, model string")
    made = results.resumed(spark.createDataFrame([("m1",), ("m3",)], "model string"), again.select("model"), ["model"], lambda rest: rest)
    assert sorted(r.model for r in made.collect()) == ["m1", "m2", "m3"]


@pytest.mark.parametrize("together", [1000, 3])
def test_intervals_of_cells_share_their_draws(spark, together):
    g = np.random.default_rng(21)
    real = [(s, f"w{k:02d}", None if (s, k) == ("y", 3) else float(v)) for s in "xy" for k, v in enumerate(g.normal(size=11).round(1))]
    made = [(s, m, f"r{k:02d}", float(v)) for s in "xy" for m in ("p", "q") for k, v in enumerate(g.normal(0.5, 1, 9).round(1))] + [("z", "p", "r00", 1.0)]
    a = spark.createDataFrame(real, "stat string, id string, value double").repartition(3)
    b = spark.createDataFrame(made, "stat string, generator string, id string, value double").repartition(3)
    draw = lambda r, s, n: [int(int(hashlib.md5(f"5|boot|{r}|{s}|{k}".encode()).hexdigest()[:8], 16) / 4294967296 * n) for k in range(n)]

    def power(x, y):
        return 2 * abs(sum((v > u) + 0.5 * (v == u) for u in x for v in y) / (len(x) * len(y)) - 0.5)

    got = {(r.stat, r.generator): (r.power, r.ci_lo, r.ci_hi) for r in twosample.cell_intervals(a, b, ["stat", "generator"], "stat", 30, 5, together).collect()}
    assert set(got) == {(s, m) for s in "xy" for m in "pq"} | {("z", "p")} - ({("z", "p")} if ("z", "p") not in got else set())
    for s, m in [(s, m) for s in "xy" for m in "pq"]:
        x, y = [v for t, _, v in real if t == s], [v for t, k, _, v in made if (t, k) == (s, m)]
        powers = [power([x[i] for i in draw(r, "a", 11) if x[i] is not None], [y[i] for i in draw(r, "b", 9)]) for r in range(30)]
        assert got[s, m] == pytest.approx((power([v for v in x if v is not None], y), *np.percentile(powers, [2.5, 97.5])))
