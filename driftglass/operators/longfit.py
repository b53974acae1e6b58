"""Maximum likelihood fits of whole series of any length, each over many tasks.

A series is cut into parts of CHUNK returns. The variance recursion s' = omega + alpha r**2 + beta s is affine in s, and so are
those of its derivatives, so a part's effect is a map from the state before it to the state after it, and maps compose. An
evaluation makes the maps of all parts, carries the state over them (a row a part), and then sums likelihood,
gradient and information of every part from its own state. All series, starting points and trial steps are evaluated
together, so a fit takes a few dozen jobs, however long the series are; series of one part need no maps.

The search scores: a step solves the information matrix, damped by several amounts where the whole step gains nothing. A series
of several parts is first searched on its first part, from all starts; the whole goes on from the places that are found.
It keeps within omega > 0, alpha, beta >= 0, alpha + beta <= CAP, along whose edges it goes on. The driver holds a few numbers
for each series; many short series are better fitted in a task each (`fitting.fit_windows`). Where a series shows no clustering,
its likelihood is a flat ridge, and the search may stop some hundredths short of the top.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass.operators.fitting import T_DF_RANGE
from driftglass.sources.shared import stored

CHUNK, STATES_MOST = 1 << 17, 1_000_000
CAP, TINY = 0.999, 1e-12
DAMPS, ROUNDS = (0.0, 0.01, 0.1, 1.0, 10.0, 100.0), 60
# The starting points (alpha, beta) and the fallback of the published fit.
STARTS, FALLBACK = ((0.08, 0.90), (0.05, 0.93), (0.12, 0.85)), (0.05, 0.08, 0.90)
# End of fixed values.
MORE_STARTS = ((0.02, 0.97), (0.1, 0.5), (0.02, 0.1), (0.3, 0.3))  # for series whose clustering is weak or short


def chunked(rows: DataFrame, by: str = "series_id", chunk: int = CHUNK) -> DataFrame:
    """key, part, last (the series' last part), spread (its variance), n, r (an array in order) of rows(by, i, r); stored."""
    rows = rows.select(F.col(by).cast("string").alias("key"), F.floor(F.col("i") / chunk).cast("long").alias("part"), "i", "r").where("r IS NOT NULL")
    about = rows.groupBy("key").agg(F.max("part").alias("last"), F.var_pop("r").alias("spread"), F.count("*").alias("n"))
    parts = rows.groupBy("key", "part").agg(F.sort_array(F.collect_list(F.struct("i", "r"))).alias("held"))
    parts = parts.select("key", "part", F.transform("held", lambda x: x["r"]).alias("r"))
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # parts are small and the work on them isn't
    return stored(parts.join(about, "key").repartition(spread, "key", "part"), "parts")


def held(column: pa.Array, k: int) -> np.ndarray:
    return column[k].values.to_numpy(zero_copy_only=False)


LANES, LEAST_STEPS, LOGS = 4096, 16, 8  # strips of a part that advance together, for all points; their least length; factors of a logarithm


def strips(q: np.ndarray, points: int) -> Iterator[np.ndarray]:
    """Squares as steps by strips: as many strips as LANES allow, then what is left over in the same way."""
    while len(q):
        n = max(1, min(LANES // points, len(q) // LEAST_STEPS))
        steps = len(q) // n
        yield np.ascontiguousarray(q[: n * steps].reshape(n, steps).T)
        q = q[n * steps :]


def maps(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For strips of squares q(step, strip) and points p: the state (s and its derivatives) after each strip that starts from nothing."""
    omega, alpha, beta = (x[:, None] for x in p.T)
    a = np.zeros((len(p), q.shape[1]))
    b, s, w = np.zeros_like(a), np.zeros_like(a), np.zeros_like(omega)
    for row in q:
        b *= beta
        b += s
        a *= beta
        a += row
        w = 1 + beta * w
        np.multiply(a, alpha, out=s)
        s += omega * w
    return np.stack([s, np.broadcast_to(w, s.shape), a, b])


def passed(state: np.ndarray, after: np.ndarray, beta: np.ndarray, n: int) -> np.ndarray:
    """The state after a stretch of n returns from the one before it (4 rows) and the stretch's own."""
    out = beta**n * state + after
    out[3] += n * beta ** (n - 1) * state[0]  # what s before the stretch adds to its derivative by beta
    return out


def carried(state: np.ndarray, after: np.ndarray, beta: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """From the state before the first of strips of n returns (4 rows by point), and what each strip makes from nothing: the states before
    the strips, and the one after the last. Maps are composed over 1, 2, 4, ... strips."""
    after[:, :, 0] = passed(state, after[:, :, 0], beta, n)
    over = 1
    while over < after.shape[2]:
        after[:, :, over:] = passed(after[:, :, :-over], after[:, :, over:], beta[:, None], n * over)
        over *= 2
    return np.concatenate([state[:, :, None], after[:, :, :-1]], axis=2), after[:, :, -1]


def mapped(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The state after a part that starts from nothing, 4 rows by point. Returns whose weight is below 1e-22 are left out, as no digit shows them."""
    reach = int(min(len(q), math.log(1e-22) / math.log(max(float(p[:, 2].max()), 1e-300)) + 2))
    state = np.zeros((4, len(p)))
    for piece in strips(q[-reach:], len(p)):
        state = carried(state, maps(piece, p), p[:, 2], len(piece))[1]
    return state


def summed(q: np.ndarray, p: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of squares q at points p from the state before them (4 rows by point): f, its gradient and information (upper half), by point."""
    omega, alpha, beta = (x[:, None] for x in p.T)
    f, g, h = np.zeros(len(p)), np.zeros((3, len(p))), np.zeros((6, len(p)))
    for piece in strips(q, len(p)):
        starts, state = carried(state, maps(piece, p), p[:, 2], len(piece))
        s, w, a, b = (np.ascontiguousarray(x) for x in starts)
        own, product, logs = np.zeros_like(s), np.ones_like(s), np.zeros_like(s)
        slopes, info, x = np.zeros((3, *s.shape)), np.zeros((6, *s.shape)), np.empty_like(s)
        shares = [np.empty_like(s) for _ in range(3)]
        for t, row in enumerate(piece):
            inverse = 1 / s
            pull = row * inverse
            own += pull
            np.subtract(1, pull, out=pull)
            product *= s
            if t % LOGS == LOGS - 1:
                logs += np.log(product)
                product[:] = 1
            for k, d in enumerate((w, a, b)):
                np.multiply(d, inverse, out=shares[k])
                slopes[k] += np.multiply(shares[k], pull, out=x)
            for k, (i, j) in enumerate(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))):
                info[k] += np.multiply(shares[i], shares[j], out=x)
            b *= beta
            b += s
            s *= beta
            s += omega + alpha * row
            a *= beta
            a += row
            w *= beta
            w += 1
        f += (own + logs + np.log(product)).sum(axis=1)
        g += slopes.sum(axis=2)
        h += info.sum(axis=2)
    return f, g, h


ROOT = (1.0, 0.0, 0.0, 0.0)  # times the spread: the state before a series


def map_batches(points: dict[str, np.ndarray]):
    """The state after each part that starts from nothing, for every point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, key in enumerate(batch.column("key").to_pylist()):
                q = held(batch.column("r"), k) ** 2
                if not len(points.get(key, ())):
                    continue
                made = mapped(q, points[key]).T
                rows = {"key": [key] * len(made), "part": [batch.column("part")[k].as_py()] * len(made), "point": range(len(made)), "n": [len(q)] * len(made), "spread": [batch.column("spread")[k].as_py()] * len(made)}
                rows |= {c: [float(m[j]) for m in made] for j, c in enumerate("swab")}
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows), preserve_index=False)

    return run


def carry(points: dict[str, np.ndarray]):
    """The state before each part of a series, for one point: maps composed in order."""

    def run(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        beta = float(points[k[0]][k[1]][2])
        state, out = np.array(ROOT) * float(rows.spread.iloc[0]), []
        for part, n, s, w, a, b in rows[["part", "n", "s", "w", "a", "b"]].itertuples(index=False):
            out.append((k[0], part, k[1], *map(float, state)))
            state = passed(state, np.array([s, w, a, b]), beta, n)
        return pd.DataFrame(out, columns=["key", "part", "point", "s", "w", "a", "b"])

    return run


SUMS = "f double, g0 double, g1 double, g2 double, h00 double, h01 double, h02 double, h11 double, h12 double, h22 double"


def sum_batches(points: dict[str, np.ndarray]):
    """Likelihood, gradient and information of each part, for every point, from the states before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, key in enumerate(batch.column("key").to_pylist()):
                states, p = batch.column("states")[k].as_py(), points.get(key, ())
                if not len(p):
                    continue
                before = [[x[c] for c in "swab"] for x in states] if states else [np.array(ROOT) * batch.column("spread")[k].as_py()] * len(p)
                f, g, h = summed(held(batch.column("r"), k) ** 2, p, np.array(before, float).T)
                out += [(key, j, float(f[j]), *map(float, g[:, j]), *map(float, h[:, j])) for j in range(len(p))]
            names = ["key", "point", *(c.split()[0] for c in SUMS.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.string() if c == 0 else pa.int32() if c == 1 else pa.float64()) for c in range(len(names))], names=names)

    return run


def likelihoods(parts: DataFrame, points: dict[str, np.ndarray]) -> DataFrame:
    """key, point, and sums of the series in parts (of `chunked`) at points[key] (rows of omega, alpha, beta): f is
    the sum of log s + r**2 / s, g its gradient, h the expected second derivatives."""
    rows = parts
    if rows.where("last > 0").take(1):
        maps = rows.where("last > 0").select("key", "part", "spread", "r").mapInArrow(map_batches(points), "key string, part long, point long, n long, spread double, s double, w double, a double, b double")
        states = maps.groupBy("key", "point").applyInPandas(carry(points), "key string, part long, point long, s double, w double, a double, b double")
        states = states.groupBy("key", "part").agg(F.sort_array(F.collect_list(F.struct("point", "s", "w", "a", "b"))).alias("states"))
        states = stored(states, "states")  # a row a part
        rows = rows.join(F.broadcast(states) if states.count() * max(map(len, points.values())) <= STATES_MOST else states, ["key", "part"], "left")
    else:
        rows = rows.withColumn("states", F.lit(None).cast("array<struct<point:long,s:double,w:double,a:double,b:double>>"))
    sums = rows.select("key", "spread", "r", "states").mapInArrow(sum_batches(points), f"key string, point int, {SUMS}")
    return sums.groupBy("key", "point").agg(*(F.sum(c.split()[0]).alias(c.split()[0]) for c in SUMS.split(", ")))


def volatility_at(parts: DataFrame) -> Callable:
    """points -> (f, gradient, matrix) of each point of each series."""

    def evaluate(points: dict[str, np.ndarray]) -> dict[tuple[str, int], tuple]:
        out = {}
        for r in likelihoods(parts, points).collect():  # a row for each series and point
            h = np.array([[r.h00, r.h01, r.h02], [r.h01, r.h11, r.h12], [r.h02, r.h12, r.h22]])
            out[r.key, r.point] = (r.f, np.array([r.g0, r.g1, r.g2]), h)
        return out

    return evaluate


def within(spread: float) -> Callable:
    def inside(p: np.ndarray) -> np.ndarray:
        omega, alpha, beta = max(p[0], TINY * spread), max(p[1], 0.0), max(p[2], 0.0)
        alpha, beta = (0.0 if x < TINY else x for x in (alpha, beta))
        over = alpha + beta
        return np.array([omega, *(x * CAP / over for x in (alpha, beta))] if over > CAP else [omega, alpha, beta])

    return inside


def ways(p: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Directions that lead nowhere out of the region against the gradient, as columns: edges that press are kept to."""
    free = [np.eye(3)[0]]
    alpha_free, beta_free = (p[k] > 0 or g[k] < 0 for k in (1, 2))
    if p[1] + p[2] >= CAP - TINY and g[1] + g[2] < 0:
        if alpha_free and beta_free:
            free.append(np.array([0.0, 1.0, -1.0]))
    else:
        free += [np.eye(3)[k] for k, ok in ((1, alpha_free), (2, beta_free)) if ok]
    return np.stack(free, axis=1)


def close(p: np.ndarray, q: np.ndarray) -> bool:
    return bool((np.abs(p - q) <= 1e-4 * np.maximum(np.abs(p), np.abs(q))).all())


def stepped(g: np.ndarray, h: np.ndarray, damp: float) -> np.ndarray:
    """A step down: the matrix in units of its diagonal, its eigenvalues made positive and damped."""
    unit = np.sqrt(np.maximum(np.abs(np.diag(h)), 1e-300))
    values, vectors = np.linalg.eigh(h / np.outer(unit, unit))
    return -(vectors @ ((vectors.T @ (g / unit)) / (np.maximum(np.abs(values), 1e-10) + damp))) / unit


def descend(evaluate: Callable, starts: dict[str, list[np.ndarray]], inside: dict[str, Callable], open_ways: Callable | None = None, tolerance: float = 1e-11) -> dict[str, list[tuple[np.ndarray, float]]]:
    """Where the starts of each key lead: points and values, the best first. All starts of all keys go down together, a round of trial steps
    at a time: the whole step first, damped ones where it gains nothing. A start stops where a step promises less than the tolerance, and
    where it comes to the place of a better one."""
    found = evaluate({k: np.array([inside[k](p) for p in ps]) for k, ps in starts.items()})
    now = {(k, j): (inside[k](p), *found[k, j]) for k, ps in starts.items() for j, p in enumerate(ps) if (k, j) in found and math.isfinite(found[k, j][0])}
    damped, tried = dict.fromkeys(now, 1.0), dict.fromkeys(now, DAMPS[:1])
    going = set(now)
    for _ in range(2 * ROUNDS):
        trials: dict[str, list[tuple]] = {}
        for at in sorted(going):
            p, f, g, h = now[at]
            basis = open_ways(p, g) if open_ways else np.eye(len(p))
            whole = basis @ stepped(basis.T @ g, basis.T @ h @ basis, 0.0)
            if -float(g @ whole) < tolerance * max(1.0, abs(f)):
                going.discard(at)
                continue
            for damp in tried[at]:
                step = basis @ stepped(basis.T @ g, basis.T @ h @ basis, damp * damped[at])
                trials.setdefault(at[0], []).append((at, inside[at[0]](p + step)))
        if not trials:
            break
        found = evaluate({k: np.array([p for _, p in ps]) for k, ps in trials.items()})
        best: dict[tuple, tuple] = {}
        for k, ps in trials.items():
            for j, (at, p) in enumerate(ps):
                value = found[k, j]
                if math.isfinite(value[0]) and (at not in best or value[0] < best[at][1]):
                    best[at] = (p, *value)
        for at in list(going):
            gain = now[at][1] - best[at][1] if at in best else 0.0
            if gain > tolerance * max(1.0, abs(now[at][1])):
                now[at], damped[at], tried[at] = best[at], 1.0, DAMPS[:1]
            elif tried[at] == DAMPS[:1]:
                tried[at] = DAMPS[1:]
            elif damped[at] > 1:
                going.discard(at)
            else:
                damped[at], tried[at] = 1e4, DAMPS  # once more, with much shorter steps
        for at in sorted(going, key=lambda at: now[at][1], reverse=True):
            if any(other != at and other[0] == at[0] and (now[other][1], other) < (now[at][1], at) and close(now[at][0], now[other][0]) for other in now):
                going.discard(at)
    out: dict[str, list[tuple[np.ndarray, float]]] = {}
    for (k, _), (p, f, *_) in sorted(now.items(), key=lambda x: x[1][1]):
        if not any(close(p, q) for q, _ in out.setdefault(k, [])):
            out[k].append((p, f))
    return out


def tail_batches(points: dict[str, np.ndarray]):
    """For each series and point (log df, log scale): the three sums that Student's likelihood needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, key in enumerate(batch.column("key").to_pylist()):
                q = held(batch.column("r"), k) ** 2
                for j, (a, b) in enumerate(points.get(key, ())):
                    z = q / math.exp(a + 2 * b)
                    w = z / (1 + z)
                    out.append((key, j, float(np.log1p(z).sum()), float(w.sum()), float((w * w).sum())))
            kinds = [pa.string(), pa.int32(), *[pa.float64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds[c]) for c in range(5)], names=["key", "point", "s1", "s2", "s3"])

    return run


def tails_at(parts: DataFrame, sizes: dict[str, int]) -> Callable:
    """points -> (f, gradient, second derivatives) of Student's t with free scale, centred, in (log df, log scale)."""
    norm = lambda v: math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi)

    def evaluate(points: dict[str, np.ndarray]) -> dict[tuple[str, int], tuple]:
        sums = parts.select("key", "r").mapInArrow(tail_batches(points), "key string, point int, s1 double, s2 double, s3 double")
        out = {}
        for r in sums.groupBy("key", "point").agg(*(F.sum(c).alias(c) for c in ("s1", "s2", "s3"))).collect():  # a row for each series and point
            a, b = points[r.key][r.point]
            n, v, e = sizes[r.key], math.exp(a), 1e-4
            c, up, down = norm(v), norm(math.exp(a + e)), norm(math.exp(a - e))
            c1, c2 = (up - down) / (2 * e), (up - 2 * c + down) / (e * e)  # by log df
            spread = r.s2 - r.s3
            f = -n * c + n * b + (v + 1) / 2 * r.s1
            g = np.array([-n * c1 + v / 2 * r.s1 - (v + 1) / 2 * r.s2, n - (v + 1) * r.s2])
            cross = -v * r.s2 + (v + 1) * spread
            out[r.key, r.point] = (f, g, np.array([[-n * c2 + v / 2 * r.s1 - v * r.s2 + (v + 1) / 2 * spread, cross], [cross, 2 * (v + 1) * spread]]))
        return out

    return evaluate


def fit_series(rows: DataFrame, by: str = "series_id", chunk: int = CHUNK) -> DataFrame:
    """by, omega, alpha, beta, t_df of every whole series of rows(by, i, r); a series without spread has no t_df and the fallback."""
    parts = chunked(rows, by, chunk)
    about = {r.key: (r.spread, r.n, r.last) for r in parts.groupBy("key").agg(*(F.first(c).alias(c) for c in ("spread", "n", "last"))).collect()}  # a row a series
    some = {k: v for k, (v, *_) in about.items() if v and v > 0}
    live = parts.where(F.col("key").isin(list(some))) if len(some) < len(about) else parts
    starts = {k: [np.array([v * (1 - a - b), a, b]) for a, b in (*STARTS, *MORE_STARTS)] for k, v in some.items()}
    tail_starts = {k: [np.array([math.log(5), 0.5 * math.log(v)])] for k, v in some.items()}
    inside, flat = {k: within(v) for k, v in some.items()}, dict.fromkeys(some, lambda p: np.array([min(p[0], 10.0), p[1]]))
    volatility, tails = volatility_at(live), tails_at(live, {k: about[k][1] for k in some})
    long = [k for k in some if about[k][2] > 0]
    if long:  # the whole begins where the first parts lead, and at the start that is best for the whole
        found = volatility({k: np.array(starts[k]) for k in long})
        heads = stored(live.where(F.col("key").isin(long) & (F.col("part") == 0)).withColumn("last", F.lit(0).cast("long")), "heads")
        sizes = {r.key: r.n for r in heads.select("key", F.size("r").alias("n")).collect()}  # a row a series
        near = descend(volatility_at(heads), {k: starts[k] for k in sizes}, inside, ways, 1e-7)
        near_tails = descend(tails_at(heads, sizes), {k: tail_starts[k] for k in sizes}, flat)
        for k in long:
            best = min((found[k, j][0], j) for j in range(len(starts[k])) if math.isfinite(found[k, j][0]))[1]
            starts[k] = [starts[k][best], *(p for p, _ in near.get(k, []))]
            tail_starts[k] = [p for p, _ in near_tails.get(k, [])] or tail_starts[k]
    volatility = descend(volatility, starts, inside, ways) if some else {}
    tails = descend(tails, tail_starts, flat) if some else {}
    out = []
    for k, (v, *_) in about.items():
        fallback = (FALLBACK[0] * (v or 0.0), *FALLBACK[1:])
        p = volatility[k][0][0].tolist() if k in volatility else fallback
        df = float(np.clip(math.exp(tails[k][0][0][0]), *T_DF_RANGE)) if k in tails else None
        out.append((k, *map(float, p), df))
    return rows.sparkSession.createDataFrame(out, f"{by} string, omega double, alpha double, beta double, t_df double")


def likelihood_table(rows: DataFrame, points: list[tuple[float, float, float]], by: str = "series_id", chunk: int = CHUNK) -> DataFrame:
    """by, point, n, f: the sum of log s + r**2 / s of every whole series at each point (omega, alpha, beta)."""
    parts = chunked(rows, by, chunk)
    sizes = parts.groupBy("key").agg(F.first("n").alias("n"))
    given = {r.key: np.array(points, float) for r in sizes.select("key").collect()}  # a row a series
    return likelihoods(parts, given).join(sizes, "key").select(F.col("key").alias(by), "point", "n", "f")

