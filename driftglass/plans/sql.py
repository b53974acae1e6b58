"""SQL for the same results as the queries, from common table expressions that are written once.

Statistics follow their definitions; window starts come from a range join and comparisons of two samples from all their
pairs, so that the SQL takes another way than the DataFrame plans.
"""

from __future__ import annotations

STATS = (
    "excess_kurtosis", "hill_right", "hill_left", "gain_loss_asymmetry", "acf_return_1", "acf_abs_1", "acf_abs_20", "acf_abs_decay",
    "ljung_box_sq", "aggregational_gaussianity", "leverage", "vol_of_vol", "multiscaling", "variance_ratio_20", "drift",
)
LINE = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
SOURCES = {
    "li6": f"SELECT l_returnflag || l_linestatus AS series_id, l_extendedprice AS price, l_shipdate AS ts, row_number() OVER (ORDER BY {LINE}) AS o FROM lineitem",
    "li3": f"SELECT l_returnflag AS series_id, l_extendedprice AS price, l_shipdate AS ts, row_number() OVER (ORDER BY {LINE}) AS o FROM lineitem",
    "ord5": "SELECT o_orderpriority AS series_id, o_totalprice AS price, o_orderdate AS ts, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS o FROM orders",
    "reg5": "SELECT r_name AS series_id, o_totalprice AS price, o_orderdate AS ts, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS o FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "ev5": "SELECT event_type AS series_id, round(value - 0.01, 2) AS price, ts, row_number() OVER (ORDER BY ts, event_id) AS o FROM events",
}


def r6(x: str) -> str:
    return f"round(CASE WHEN isfinite(({x})::DOUBLE) THEN ({x})::DOUBLE END, 6) + 0.0"


def returns(source: str) -> str:
    return f"""src AS ({SOURCES[source]}),
lp AS (SELECT series_id, o, CASE WHEN price > 0 THEN ln(price) END AS v FROM src WHERE price IS NOT NULL),
df AS (SELECT series_id, o, v - lag(v) OVER (PARTITION BY series_id ORDER BY o) AS r FROM lp),
ret AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY o) - 1 AS i, r / stddev_pop(r) OVER (PARTITION BY series_id) AS r FROM df WHERE r IS NOT NULL)"""


def windows(source: str = "li6", window: int = 1000, stride: int = 250) -> str:
    return f"""{returns(source)},
st AS (SELECT series_id, unnest(range(0, n - {window} + 1, {stride})) AS start FROM (SELECT series_id, count(*) AS n FROM ret GROUP BY 1) WHERE n >= {window}),
w AS (SELECT ret.series_id, st.start, ret.i, ret.r FROM st JOIN ret ON ret.series_id = st.series_id AND ret.i BETWEEN st.start AND st.start + {window - 1})"""


def hill(side: str, frac: str) -> str:
    rank, of, n = ("down", "r > 0", "np") if side == "right" else ("up", "r < 0", "nn")
    k = f"greatest(floor({n} * {frac}::DOUBLE)::INT, 10)"
    mean = f"(sum(ln(abs(r))) FILTER (WHERE {of} AND {rank} <= {k}) / any_value({k}) - ln(max(abs(r)) FILTER (WHERE {of} AND {rank} = {k} + 1)))"
    return f"CASE WHEN any_value({n}) > any_value({k}) AND {mean} > 1e-12 THEN 1 / {mean} END"


def ranked(src: str, key: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY r DESC) AS down, row_number() OVER (PARTITION BY {key} ORDER BY r) AS up,
  count(*) FILTER (WHERE r > 0) OVER (PARTITION BY {key}) AS np, count(*) FILTER (WHERE r < 0) OVER (PARTITION BY {key}) AS nn FROM {src}"""


def facts(src: str = "w", key: str = "series_id, start", p: str = "f") -> str:
    """CTEs up to {p}facts: key and the statistics."""
    lags = ", ".join(["x * lag(x, 1) OVER o AS x1"] + [f"y * lag(y, {k}) OVER o AS y{k}" for k in range(1, 51)] + [f"z * lag(z, {k}) OVER o AS z{k}" for k in range(1, 21)] + [f"lead(abs(r), {k}) OVER o AS h{k}" for k in range(1, 6)])
    acf = lambda c, n: "[" + ", ".join(f"sum({c}{k}) / nullif(sum({c} * {c}), 0)" for k in range(1, n + 1)) + "]"
    corr = ", ".join(f"CASE WHEN stddev_pop(h{k}) > 0 AND stddev_pop(r) FILTER (WHERE h{k} IS NOT NULL) > 0 THEN corr(r, h{k}) END" for k in range(1, 6))
    return f"""{p}c AS (SELECT *, r - avg(r) OVER k AS x, abs(r) - avg(abs(r)) OVER k AS y, r * r - avg(r * r) OVER k AS z FROM ({ranked(src, key)}) WINDOW k AS (PARTITION BY {key})),
{p}l AS (SELECT *, {lags} FROM {p}c WINDOW o AS (PARTITION BY {key} ORDER BY i)),
{p}d AS (SELECT {key}, count(*) AS n, kurtosis_pop(r) AS excess_kurtosis, avg(x * x * x) / nullif(pow(stddev_pop(r), 3), 0) AS gain_loss_asymmetry, avg(r) / nullif(stddev_pop(r), 0) AS drift,
  sum(x1) / nullif(sum(x * x), 0) AS acf_return_1, {acf("y", 50)} AS ya, {acf("z", 20)} AS za, [{corr}] AS co, {hill("right", "0.05")} AS hill_right, {hill("left", "0.05")} AS hill_left
  FROM {p}l GROUP BY {key}),
{p}e AS (SELECT {key}, CASE WHEN count(*) FILTER (WHERE a > 1e-6) >= 10 THEN regr_slope(ln(CASE WHEN a > 1e-6 THEN a END), ln(k)) END AS acf_abs_decay
  FROM (SELECT {key}, unnest(ya) AS a, unnest(range(1, 51)) AS k FROM {p}d) GROUP BY {key}),
{p}q AS (SELECT {key}, ln(any_value(n) * (any_value(n) + 2) * sum(a * a / (n - k)) + 1e-12) AS ljung_box_sq FROM (SELECT {key}, n, unnest(za) AS a, unnest(range(1, 21)) AS k FROM {p}d) GROUP BY {key}),
{p}v AS (SELECT {key}, avg(c) AS leverage FROM (SELECT {key}, unnest(co) AS c FROM {p}d) GROUP BY {key}),
{p}j AS (SELECT {key}, r, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY {key}) AS n FROM {src}),
{p}b AS (SELECT {key}, scale, j // scale AS block, sum(r) AS s, stddev_pop(r) AS sd FROM (SELECT *, unnest([1, 2, 5, 10, 20, 21]) AS scale FROM {p}j) WHERE j < n - n % scale GROUP BY {key}, scale, block),
{p}s AS (SELECT {key}, scale, count(*) AS blocks, kurtosis_pop(s) AS ku, var_pop(s) AS va, avg(abs(s)) AS m1, avg(s * s) AS m2, stddev_pop(ln(CASE WHEN sd > 0 THEN sd END)) AS ls, count(*) FILTER (WHERE sd > 0) AS mv FROM {p}b GROUP BY {key}, scale),
{p}m AS (SELECT {key}, max(ku) FILTER (WHERE scale = 5 AND blocks >= 50) AS k5, max(ls) FILTER (WHERE scale = 21 AND mv >= 10) AS vol_of_vol, max(va) FILTER (WHERE scale = 20) / 20 AS v20,
  CASE WHEN count(*) FILTER (WHERE scale <> 21 AND blocks >= 30) = 5 THEN regr_slope(ln(m1), ln(scale)) FILTER (WHERE scale <> 21) - regr_slope(ln(m2), ln(scale)) FILTER (WHERE scale <> 21) / 2 END AS multiscaling FROM {p}s GROUP BY {key}),
{p}t AS (SELECT {key}, CASE WHEN count(*) >= 200 AND var_pop(r) > 0 THEN var_pop(r) END AS v1 FROM {p}j WHERE j < n - n % 20 GROUP BY {key}),
{p}facts AS (SELECT {key}, excess_kurtosis, hill_right, hill_left, gain_loss_asymmetry, acf_return_1, ya[1] AS acf_abs_1, ya[20] AS acf_abs_20, acf_abs_decay, ljung_box_sq,
  excess_kurtosis - k5 AS aggregational_gaussianity, leverage, vol_of_vol, multiscaling, v20 / v1 AS variance_ratio_20, drift
  FROM {p}d JOIN {p}e USING ({key}) JOIN {p}q USING ({key}) JOIN {p}v USING ({key}) JOIN {p}m USING ({key}) JOIN {p}t USING ({key})),
{p}long AS (UNPIVOT (SELECT {key}, {", ".join(f"CASE WHEN isfinite({s}) THEN {s} END AS {s}" for s in STATS)} FROM {p}facts) ON {", ".join(STATS)} INTO NAME stat VALUE value)"""


def fact(*stats: str) -> str:
    return f"WITH {windows()}, {facts()} SELECT series_id, start, {', '.join(f'{r6(s)} AS {s}' for s in stats)} FROM ffacts"


SPLIT = "CASE WHEN series_id IN ('AF', 'AO', 'NF', 'NO') THEN 'a' ELSE 'b' END"


def compared(by: str, src: str = "sam", p: str = "c") -> str:
    """CTEs up to {p}mp: by, n_a, n_b, auc, power, ks of src(by, side, value)."""
    return f"""{p}n AS (SELECT {by}, count(value) FILTER (WHERE side = 'a') AS n_a, count(value) FILTER (WHERE side = 'b') AS n_b FROM {src} GROUP BY {by}),
{p}u AS (SELECT {by}, sum(CASE WHEN y.value > x.value THEN 1.0 WHEN y.value = x.value THEN 0.5 ELSE 0 END)::DOUBLE AS u FROM (SELECT * FROM {src} WHERE side = 'a') x JOIN (SELECT * FROM {src} WHERE side = 'b') y USING ({by}) WHERE x.value IS NOT NULL AND y.value IS NOT NULL GROUP BY {by}),
{p}e AS (SELECT {by}, count(*) FILTER (WHERE side = 'a') OVER g AS ca, count(*) FILTER (WHERE side = 'b') OVER g AS cb FROM {src} WHERE value IS NOT NULL WINDOW g AS (PARTITION BY {by} ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{p}k AS (SELECT {by}, max(abs(ca * n_b - cb * n_a)) AS gap FROM {p}e JOIN {p}n USING ({by}) GROUP BY {by}),
{p}mp AS (SELECT {by}, n_a, n_b, gap, CASE WHEN least(n_a, n_b) >= 5 THEN u / (n_a * n_b) END AS auc, CASE WHEN least(n_a, n_b) >= 5 THEN 2 * abs(u / (n_a * n_b) - 0.5) END AS power,
  CASE WHEN least(n_a, n_b) >= 5 THEN gap::DOUBLE / (n_a * n_b) END AS ks FROM {p}n JOIN {p}u USING ({by}) JOIN {p}k USING ({by}))"""


def bits(*key: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 8))::BIGINT"


def uniform(*key: str) -> str:
    return f"({bits(*key)} / 4294967296.0::DOUBLE)"


def inner(*key: str) -> str:
    return f"(({bits(*key)} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def normal(*key: str) -> str:
    return f"(sqrt(-2 * ln({inner(*key, '0')})) * cos(2 * pi() * {uniform(*key, '1')}))"


def student(df: float, *key: str) -> str:
    raw = f"sqrt({df}::DOUBLE * (pow({inner(*key, '0')}, -2 / {df}::DOUBLE) - 1)) * cos(2 * pi() * {uniform(*key, '1')})"
    return f"({raw} / sqrt({df}::DOUBLE / ({df}::DOUBLE - 2)))"


SEED = 20260802


def steps(runs: int, n: int, first: int = 0) -> str:
    return f"(SELECT a.run, b.t FROM range({runs}) AS a(run), range({first}, {n}) AS b(t))"


POOL = "pool AS (SELECT row_number() OVER (ORDER BY series_id, i) - 1 AS g, r FROM ret), big AS (SELECT count(*) AS size FROM pool)"


def generator(name: str, runs: int, n: int, df: float = 5.0) -> str:
    """A SELECT of generator, run, i, r; the bootstraps need pool and big."""
    key = (str(SEED), f"'{name}'", "run", "t")
    if name == "gaussian":
        return f"SELECT '{name}' AS generator, run, t AS i, {normal(*key)} AS r FROM {steps(runs, n)}"
    if name == "student_t":
        return f"SELECT '{name}' AS generator, run, t AS i, {student(df, *key)} AS r FROM {steps(runs, n)}"
    if name.startswith("garch"):
        return f"SELECT '{name}' AS generator, run, t AS i, sqrt(s2) * e AS r FROM ({volatility_path(name, runs, n, df)}) WHERE t >= 0"
    at = f"floor({uniform(*key)} * size)::BIGINT" if name == "iid_bootstrap" else f"floor({uniform(*key[:3], '(t // 20)')} * (size - 20))::BIGINT + t % 20"
    return f"SELECT '{name}' AS generator, run, t AS i, r FROM (SELECT run, t, {at} AS g FROM {steps(runs, n)}, big) JOIN pool USING (g)"


def generated(names, runs: int, n: int) -> str:
    return " UNION ALL ".join(f"({generator(x, runs, n)})" for x in names)


VOLATILITY = (0.02, 0.1, 0.85)


def volatility_path(name: str, runs: int, n: int, df: float = 5.0, parameters=VOLATILITY) -> str:
    """A SELECT of run, t, s2, e of GARCH(1,1) paths, after 500 steps that count below 0."""
    o, a, b = (f"{x}::DOUBLE" for x in parameters)
    key = (str(SEED), f"'{name}'", "run", "t")
    return f"""WITH RECURSIVE e AS (SELECT run, t, {normal(*key) if name == "garch_norm" else student(df, *key)} AS e FROM {steps(runs, n, -500)}),
path AS (SELECT run, t, {o} / greatest(1e-8, 1 - {a} - {b}) AS s2, e FROM e WHERE t = -500
  UNION ALL SELECT e.run, e.t, {o} + {a} * path.s2 * path.e * path.e + {b} * path.s2, e.e FROM path JOIN e ON e.run = path.run AND e.t = path.t + 1)
SELECT * FROM path"""
