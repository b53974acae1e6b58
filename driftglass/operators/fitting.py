"""Maximum likelihood fits, one for each group of returns of bounded length (a window), spread over the groups by Spark."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT = "omega double, alpha double, beta double, t_df double"
T_DF_RANGE = (2.5, 30.0)


def simplex_minimum(f: Callable, start, tolerance: float = 1e-8, most: int = 600) -> tuple[np.ndarray, float]:
    """Downhill simplex search."""
    start = np.asarray(start, float)
    points = np.vstack([start, start + np.diag(np.where(start != 0, 0.05 * start, 0.00025))])
    values = np.array([f(p) for p in points])
    for _ in range(most):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if np.ptp(values) <= tolerance and np.ptp(points, axis=0).max() <= tolerance:
            break
        middle = points[:-1].mean(axis=0)
        at = lambda c: (p := middle + c * (points[-1] - middle), f(p))  # noqa: E731, B023
        tried = at(-1.0)
        if tried[1] < values[0]:
            further = at(-2.0)
            tried = further if further[1] < tried[1] else tried
        elif tried[1] >= values[-2]:
            tried = at(-0.5) if tried[1] < values[-1] else at(0.5)
            if tried[1] >= values[-1]:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
                continue
        points[-1], values[-1] = tried
    best = int(np.argmin(values))
    return points[best], float(values[best])


STRIP = 128


def variances(squares: np.ndarray, first: float, omega: float, alpha: float, beta: float) -> np.ndarray:
    """s of s[0] = first, s[t] = omega + alpha * squares[t - 1] + beta * s[t - 1]."""
    return affine_path(omega + alpha * squares, first, beta)


def affine_path(pushes: np.ndarray, first: float, beta: float) -> np.ndarray:
    """x of x[0] = first, x[t] = pushes[t - 1] + beta * x[t - 1]: strips of STRIP steps at once, one after another."""
    n = len(pushes)
    push = np.zeros(-(-n // STRIP) * STRIP)
    push[1:n] = pushes[:-1]
    decay = beta ** np.arange(STRIP)
    lags = np.arange(STRIP)[:, None] - np.arange(STRIP)
    own = push.reshape(-1, STRIP) @ np.where(lags >= 0, beta ** np.maximum(lags, 0), 0).T
    before = np.empty(len(own))
    s = first / beta if beta > 0 else 0.0
    for k in range(len(own)):
        before[k] = s
        s = own[k, -1] + decay[-1] * beta * s
    out = (own + beta * before[:, None] * decay).ravel()[:n]
    if n:
        out[0] = first
    return out


def fit_volatility(r: np.ndarray) -> tuple[float, float, float]:
    """omega, alpha, beta of a GARCH(1,1) by Gaussian likelihood; the recursion starts at the sample variance."""
    spread, squares = float(r.var()), r * r

    def loss(p) -> float:
        omega, alpha, beta = map(float, p)
        if omega <= 0 or alpha < 0 or beta < 0 or alpha + beta >= 0.999:
            return 1e10
        s2 = variances(squares, spread, omega, alpha, beta)
        return float((np.log(s2) + squares / s2).sum()) if s2.min() > 0 else 1e10

    # The starting points and tolerance of the published fit.
    fallback, starts, tolerance = (0.05 * spread, 0.08, 0.90), ((0.08, 0.90), (0.05, 0.93), (0.12, 0.85)), 1e-8
    found = min((simplex_minimum(loss, (spread * (1 - a - b), a, b), tolerance, 2000) for a, b in starts), key=lambda x: x[1])
    return tuple(map(float, found[0])) if found[1] < 1e10 else fallback


def fit_t_df(r: np.ndarray) -> float:
    """Degrees of freedom of a centred Student's t with free scale, within T_DF_RANGE."""

    def loss(p) -> float:
        df, scale = math.exp(min(p[0], 10)), math.exp(p[1])
        norm = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - math.log(scale)
        return -(len(r) * norm - (df + 1) / 2 * np.log1p((r / scale) ** 2 / df).sum())

    df = math.exp(simplex_minimum(loss, (math.log(5), math.log(max(r.std(), 1e-8))), 1e-6)[0][0])
    return float(np.clip(df, *T_DF_RANGE))


def simplex_minima(f: Callable, starts: np.ndarray, tolerance: float = 1e-8, most: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """`simplex_minimum` of many searches, a row of starts each, in step. f(points, rows) gives the values of points, each of the search
    of that number; searches that have ended are asked nothing more."""
    m, dim = starts.shape
    points = np.repeat(starts[:, None], dim + 1, axis=1)
    for k in range(dim):
        points[:, k + 1, k] += np.where(starts[:, k] != 0, 0.05 * starts[:, k], 0.00025)
    values = np.stack([f(points[:, k], np.arange(m)) for k in range(dim + 1)], axis=1)
    going = np.arange(m)
    for _ in range(most):
        order = np.argsort(values[going], axis=1, kind="stable")
        points[going] = np.take_along_axis(points[going], order[:, :, None], axis=1)
        values[going] = np.take_along_axis(values[going], order, axis=1)
        done = (np.ptp(values[going], axis=1) <= tolerance) & (np.ptp(points[going], axis=1).max(axis=1) <= tolerance)
        going = going[~done]
        if not len(going):
            break
        held, levels = points[going], values[going]
        middle = held[:, :-1].mean(axis=1)
        away = held[:, -1] - middle
        found = middle - away
        value = f(found, going)
        # A second point, where there is one: further out, or inwards on the better side.
        further, inwards = value < levels[:, 0], value >= levels[:, -2]
        outside = inwards & (value < levels[:, -1])
        second = np.flatnonzero(further | inwards)
        by = np.where(further, -2.0, np.where(outside, -0.5, 0.5))[second, None]
        tried = middle[second] + by * away[second]
        tried_value = f(tried, going[second])
        taken = inwards[second] | (tried_value < value[second])
        found[second[taken]], value[second[taken]] = tried[taken], tried_value[taken]
        shrunk = inwards & (value >= levels[:, -1])
        points[going[~shrunk], -1], values[going[~shrunk], -1] = found[~shrunk], value[~shrunk]
        at = going[shrunk]
        if len(at):
            points[at, 1:] = points[at, :1] + 0.5 * (points[at, 1:] - points[at, :1])
            for k in range(1, dim + 1):
                values[at, k] = f(points[at, k], at)
    best = np.argmin(values, axis=1)
    return points[np.arange(m), best], values[np.arange(m), best]


LANES, LOGS = 8192, 8  # numbers that a step works on; factors of a logarithm


def fit_volatilities(r: np.ndarray) -> np.ndarray:
    """`fit_volatility` of each column of r. The fewer searches go on, the more strips a window is cut into, which advance together: first
    from nothing, then, with what the strips before them leave, once more."""
    n, squares = r.shape[1], r * r
    spread, tolerance = r.var(axis=0), 1e-8
    divisors = [k for k in range(1, len(r) // 16 + 2) if len(r) % k == 0]
    cut = {k: np.ascontiguousarray(squares.reshape(k, -1, n).transpose(1, 0, 2)) for k in divisors}

    def loss(p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        omega, alpha, beta = np.ascontiguousarray(p.T)
        out = np.full(len(p), 1e10)
        fine = np.flatnonzero((omega > 0) & (alpha >= 0) & (beta >= 0) & (alpha + beta < 0.999))
        if not len(fine):
            return out
        omega, alpha, beta, of = omega[fine], alpha[fine], beta[fine], rows[fine] % n
        strips = max(k for k in divisors if k == 1 or k * len(fine) <= LANES)
        held = np.take(cut[strips], of, axis=2)
        pushes = held * alpha
        pushes += omega
        s, power = np.zeros(held.shape[1:]), beta ** len(held)
        for push in pushes:
            s *= beta
            s += push
        before = spread[of]
        for k in range(strips):
            s[k], before = before, s[k] + power * before
        total, product, pull = np.zeros(s.shape), np.ones(s.shape), np.empty(s.shape)
        for t, (row, push) in enumerate(zip(held, pushes)):
            product *= s
            if t % LOGS == LOGS - 1:
                total += np.log(product)
                product[:] = 1
            total += np.divide(row, s, out=pull)
            s *= beta
            s += push
        total += np.log(product)
        total = total.sum(axis=0)
        out[fine] = np.where(np.isfinite(total), total, 1e10)
        return out

    # The starting points of the published fit.
    starts = ((0.08, 0.90), (0.05, 0.93), (0.12, 0.85))
    fallback = np.stack([0.05 * spread, np.full(n, 0.08), np.full(n, 0.90)], axis=1)
    begin = np.concatenate([np.stack([spread * (1 - a - b), np.full(n, a), np.full(n, b)], axis=1) for a, b in starts])
    with np.errstate(all="ignore"):  # of windows without spread
        found, value = simplex_minima(loss, begin, tolerance, 2000)
    best = value.reshape(len(starts), n).argmin(axis=0)
    at = best * n + np.arange(n)
    return np.where((value[at] < 1e10)[:, None], found[at], fallback)


def fit_t_dfs(r: np.ndarray) -> np.ndarray:
    """`fit_t_df` of each column of r."""
    squares = np.ascontiguousarray((r * r).T)

    def loss(p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        df, log_scale = np.exp(np.minimum(p[:, 0], 10)), np.maximum(p[:, 1], -100)  # of returns that are all zero no scale is the least
        scale = np.exp(log_scale)
        norm = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi) for v in df]) - log_scale
        z = np.take(squares, rows, axis=0)
        z *= (1 / (scale * scale * df))[:, None]
        return -(r.shape[0] * norm - (df + 1) / 2 * np.log1p(z, out=z).sum(axis=1))

    begin = np.stack([np.full(r.shape[1], math.log(5)), np.log(np.maximum(r.std(axis=0), 1e-8))], axis=1)
    found, _ = simplex_minima(loss, begin, 1e-6)
    return np.clip(np.exp(found[:, 0]), *T_DF_RANGE)


AT_ONCE = 512  # windows that are fitted together


def fit_windows(windows: DataFrame, key=("series_id", "start")) -> DataFrame:
    """key, omega, alpha, beta, t_df of every window of windows(key, i, r). The windows of a task that have one length are fitted
    together, up to AT_ONCE, as a step of many searches takes little longer than one's. The number of partitions is given, as windows
    are small and the work on them isn't."""
    names = [c.split()[0] for c in FIT.split(", ")]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            for size in np.unique(sizes):
                whole = np.flatnonzero(sizes == size)
                for first in range(0, len(whole), AT_ONCE):
                    at = pa.array(whole[first : first + AT_ONCE])
                    rows = batch.take(at)
                    r = np.ascontiguousarray(rows.column("r").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size).T)
                    fits = np.column_stack([fit_volatilities(r), fit_t_dfs(r)])
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in key), *map(pa.array, fits.T)], names=[*key, *names])

    kinds = dict(windows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in key) + ", " + FIT
    rows = windows.select(*key, "i", "r").repartition(2 * int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    rows = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "r"))).alias("rows"))
    return rows.select(*key, F.size("rows").alias("n"), F.transform("rows", lambda x: x["r"]).alias("r")).mapInArrow(fit, schema)
