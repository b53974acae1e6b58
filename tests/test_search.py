import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftglass.functions import keyed, sobol
from driftglass.operators import battery, calibration, search
from driftglass.sources.stages import Stages


def test_points_are_spread_evenly(spark):
    n = 256
    rows = spark.range(n).select("id", *(sobol.point(F.col("id"), d, 5, "m").alias(f"x{d}") for d in range(6))).toPandas()
    for d in range(6):
        assert sorted((rows[f"x{d}"] * n).astype(int)) == list(range(n))
    for a in range(6):  # one point in each of the 256 boxes of some shape, which random points never do
        for b in range(a):
            shapes = [len(set(zip((rows[f"x{a}"] * (1 << k)).astype(int), (rows[f"x{b}"] * (n >> k)).astype(int)))) for k in range(9)]
            assert max(shapes[1:8]) >= 192 if (a, b) != (1, 0) else min(shapes) == n
    with pytest.raises(ValueError):
        sobol.directions(sobol.MOST)


RANGES = {"bowl": {"x": (-2.0, 3.0, False, None), "y": (0.0, 10.0, True, 9.0), "z": (1.0, 2.0, False, 1.0)}, "line": {"k": (0.0, 40.0, True, 40.0)}, "fixed": {}, "never": {"q": (0.0, 1.0, False, None)}}


def value(model, p):
    if model == "bowl":
        return None if p["x"] > 2.5 else (p["x"] - 0.3) ** 2 + 0.1 * (p["y"] - 4) ** 2 + (p["z"] - 1.7) ** 2 * abs(p["x"])
    return {"line": lambda: abs(p["k"] - 13.0), "fixed": lambda: 7.0, "never": lambda: None}[model]()


def judge(candidates):
    p = lambda n: F.col("params")[n]
    bowl = F.when(p("x") <= 2.5, F.pow(p("x") - 0.3, F.lit(2.0)) + 0.1 * F.pow(p("y") - 4, F.lit(2.0)) + F.pow(p("z") - 1.7, F.lit(2.0)) * F.abs(p("x")))
    loss = F.when(F.col("model") == "bowl", bowl).when(F.col("model") == "line", F.abs(p("k") - 13)).when(F.col("model") == "fixed", 7.0)
    return candidates.select("candidate", loss.alias("loss"), F.when(loss.isNull(), "gate").alias("reason"))


def plain(spark, draws, starts, passes, seed=3):
    """The search, one candidate after another."""
    out = {}
    for m, ranges in RANGES.items():
        points = [(search.preset(ranges))]
        if ranges:
            xs = spark.range(draws).select(*(sobol.point(F.col("id"), d, seed, m).alias(p) for d, p in enumerate(sorted(ranges)))).collect()
            points += [{p: (lambda v: float(np.round(v)) if ranges[p][2] else v)(ranges[p][0] + (ranges[p][1] - ranges[p][0]) * x[p]) for p in ranges} for x in xs]
        fine = sorted(((value(m, p), k, p) for k, p in enumerate(points) if value(m, p) is not None), key=lambda x: x[:2])
        ends = []
        for loss, _, p in fine[:starts]:
            for _ in range(passes):
                gain = False
                for name in sorted(ranges):
                    lo, hi = ranges[name][:2]
                    tried = [p | {name: search.settled(p[name] + way * search.STEP * (hi - lo), ranges[name])} for way in (-1, 1)]
                    tried = [(value(m, t), t) for t in tried if value(m, t) is not None]
                    best = min(tried, key=lambda t: t[0], default=None)
                    if best and best[0] < loss - 1e-9:
                        loss, p, gain = *best, True
                if not gain:
                    break
            ends.append((loss, p))
        if ends:
            out[m] = min(ends, key=lambda e: e[0])
    return out


@pytest.mark.parametrize(("starts", "passes"), [(1, 1), (3, 4)])
def test_matches_a_search_one_by_one(spark, tmp_path, starts, passes):
    got = {r.model: r for r in search.search(spark, RANGES, judge, str(tmp_path), "v1", 16, 3, starts, passes).collect()}
    want = plain(spark, 16, starts, passes)
    assert set(got) == set(want) == {"bowl", "line", "fixed"}
    for m, (loss, p) in want.items():
        assert got[m].loss == pytest.approx(loss) and got[m].params == pytest.approx(p)
        assert got[m].loss <= got[m].default_loss


def test_a_killed_search_goes_on_at_its_stage(spark, tmp_path):
    calls = []

    def counted(candidates):
        calls.append(candidates.count())
        return judge(candidates)

    def dies(at):
        def run(candidates):
            if len(calls) == at:
                raise RuntimeError("killed")
            return counted(candidates)

        return run

    whole = search.search(spark, RANGES, counted, str(tmp_path / "a"), "v1", 8, 3, 2, 2).collect()
    total, first = len(calls), list(calls)
    for stop in (1, total // 2, total - 1):
        calls.clear()
        with pytest.raises(RuntimeError):
            search.search(spark, RANGES, dies(stop), str(tmp_path / f"b{stop}"), "v1", 8, 3, 2, 2)
        again = search.search(spark, RANGES, counted, str(tmp_path / f"b{stop}"), "v1", 8, 3, 2, 2).collect()
        assert sorted(map(str, again)) == sorted(map(str, whole)) and calls == first
    calls.clear()
    search.search(spark, RANGES, counted, str(tmp_path / "a"), "v1", 8, 3, 2, 2)
    assert calls == []
    search.search(spark, RANGES, counted, str(tmp_path / "a"), "v2", 8, 3, 2, 2)
    assert calls == first  # another version is another search


def test_stages_without_a_marker_are_made_again(spark, tmp_path):
    stages = Stages(spark, str(tmp_path), "v", "model string, n int")
    make = lambda ms: spark.createDataFrame([(m, len(m)) for m in ms], "model string, n int")
    assert stages.of("s", ["a"], make).count() == 1 and stages.of("s", ["a", "bb"], make).count() == 2
    assert stages.made == [("s", ("a",)), ("s", ("bb",))]
    for p in tmp_path.glob("version=v/stage=s/*/_SUCCESS"):
        p.unlink()
    assert stages.rows("s").count() == 0 and stages.of("s", ["a"], make).count() == 1


def test_generator_candidates(spark):
    pool = spark.range(400).select(F.col("id").alias("g"), keyed.normal(1, F.col("id")).alias("r"))
    rows = [(f"{m}-{k}", m, search.preset(r) | extra) for m, r in search.RANGES.items() for k, extra in enumerate([{}, {"df": 3.0, "block": 2.0, "alpha": 0.2}])]
    candidates = spark.createDataFrame([(c, m, {p: v for p, v in ps.items() if p in search.RANGES[m]}) for c, m, ps in rows], "candidate string, model string, params map<string,double>")
    made = search.paths(candidates, pool, 3, 10, 950).toPandas()
    assert made.groupby(["candidate", "seed"]).i.agg(["count", "min", "max"]).value_counts().to_dict() == {(950, 0, 949): 36}
    held = {r.g: r.r for r in pool.collect()}
    assert set(made[made.candidate == "block_bootstrap-0"].r.round(9)) <= {round(v, 9) for v in held.values()}
    same = made[made.candidate.isin(["gaussian-0", "gaussian-1"])].pivot(index=["seed", "i"], columns="candidate", values="r")
    assert (same["gaussian-0"] == same["gaussian-1"]).all()  # the same random numbers
    assert abs(made[made.candidate == "garch_norm-0"].r.var() - 1) < 0.5
    target = spark.createDataFrame([(s, t, 1.0) for s, t in (("excess_kurtosis", 3.0), ("acf_abs_1", 0.2), ("acf_return_1", 0.0))], "stat string, target double, scale double")
    got = {r.candidate: r.loss for r in search.evaluated(pool, target, 3, None, 10, 950)(candidates).collect()}
    paths = spark.createDataFrame(made).where("candidate = 'student_t-1'")
    facts = battery.evaluate(paths, ("candidate", "seed")).toPandas()
    want = sum((float(np.median(facts[s])) - t) ** 2 for s, t in (("excess_kurtosis", 3.0), ("acf_abs_1", 0.2), ("acf_return_1", 0.0)))
    assert set(got) == {c for c, *_ in rows} and got["student_t-1"] == pytest.approx(want) and all(math.isfinite(v) for v in got.values())
    assert calibration.FITTED == ("excess_kurtosis", "acf_abs_1", "acf_return_1")
