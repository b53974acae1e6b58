"""Queries over the driver's tables: one for every operator, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.functions import scalars, sobol, text
from driftglass.operators import battery, calibration, cells, fitting, generators, longfit, reports, robustness, search, sequence, twosample
from driftglass.operators.windows import sliding, tail
from driftglass.plans import sql
from driftglass.sources import documents, loader, results, series
from driftglass.sources.shared import shared_dir, stored
from driftglass.streaming import audits

NATIVE = ("gaussian", "student_t", "iid_bootstrap", "block_bootstrap", "garch_norm", "garch_t")
CELL = ["stat", "generator"]
RUNS, PERMUTATIONS, BOOTSTRAPS, T_DF, VOLATILITY = 200, 2000, 1000, 5.0, sql.VOLATILITY
WORDS = {"the": "the ", "and": " and ", "der": " der ", "que": "que[ ,.]"}
MENTION, SIMULATION = "the |der ", " and | que "


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, without negative zeros."""
    return df.select(*(F.round(c, 6) + F.lit(0.0) if t == "double" else F.col(c) for c, t in df.dtypes)).toDF(*df.columns)


def windows_of(spark: SparkSession, d: str, source: str = "li6", stride: int = 250) -> DataFrame:
    return sliding(series.measured(series.SETS[source](spark, d)), stride=stride)


def facts_of(spark: SparkSession, d: str) -> DataFrame:
    return battery.evaluate(windows_of(spark, d))


def long_of(spark: SparkSession, d: str, stride: int = 250) -> DataFrame:
    """Stored, as comparisons read it several times; it has a row for each `stride` returns and statistic."""
    return battery.unpivoted(stored(battery.evaluate(windows_of(spark, d, stride=stride)), "facts"))


def split(long: DataFrame) -> DataFrame:
    """Two groups of series: the real against the real."""
    return long.withColumn("side", F.when(F.col("series_id").isin("AF", "AO", "NF", "NO"), "a").otherwise("b"))


def synthetic(spark: SparkSession, d: str, names=NATIVE, runs: int = RUNS, n: int = 1000) -> DataFrame:
    """generator, run, i, r."""
    pool = generators.pooled(series.returns(series.li6(spark, d)))
    return generators.all_generators(pool, dict(zip(("omega", "alpha", "beta"), VOLATILITY)) | {"t_df": T_DF}, runs, n, names)


def synthetic_long(spark: SparkSession, d: str, names=NATIVE) -> DataFrame:
    key = ("generator", "run")
    return battery.unpivoted(stored(battery.evaluate(synthetic(spark, d, names), key), "facts"), key)


def against(spark: SparkSession, d: str, names=NATIVE, stride: int = 250) -> DataFrame:
    """stat, generator, n_a, n_b, auc, power, ks: all windows against all runs, every statistic and generator at once."""
    real, made = long_of(spark, d, stride).select("stat", "value"), synthetic_long(spark, d, names).select("generator", "stat", "value")
    return twosample.compared_cells(real, made, ["stat", "generator"], "stat").drop("gap")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return rounded(battery.evaluate(windows_of(spark, d, "li3")).select("series_id", "start", "excess_kurtosis", "acf_abs_1", "acf_abs_20", "leverage", "drift", "variance_ratio_20"))


def returns_query(source: str):
    return lambda spark, d: rounded(series.returns(series.SETS[source](spark, d)))


def windows_query(stride: int):
    return lambda spark, d: rounded(windows_of(spark, d, stride=stride).groupBy("series_id", "start").agg(F.count("*").alias("n"), F.sum("r").alias("total")))


def fact_query(*stats: str):
    return lambda spark, d: rounded(facts_of(spark, d).select("series_id", "start", *stats))


def generator_query(name: str):
    return lambda spark, d: rounded(synthetic(spark, d, (name,), 20, 100))


def gen_garch(spark: SparkSession, d: str) -> DataFrame:
    return rounded(generators.garch(spark, 4, 100, *VOLATILITY))


def permutation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(twosample.permutation_test(split(long_of(spark, d)), ["stat"], ["series_id", "start"], PERMUTATIONS, sql.SEED))


def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(twosample.bootstrap_power(split(long_of(spark, d)), ["stat"], ["series_id", "start"], BOOTSTRAPS, sql.SEED))


def real_vs_real(spark: SparkSession, d: str) -> DataFrame:
    return rounded(twosample.compared(split(long_of(spark, d)), ["stat"]).drop("gap"))


def fitted_sides(spark: SparkSession, d: str, runs: int = RUNS) -> tuple[DataFrame, DataFrame]:
    """Long facts (stat, id, value) of all windows, and (stat, generator, id, value) of runs of generators fitted to the whole first series."""
    rows = series.measured(series.li6(spark, d))
    fit = longfit.fit_series(rows.where("series_id = 'AF'")).first()
    made = battery.evaluate(generators.all_generators(generators.pooled(rows), fit.asDict(), runs, 1000), ("generator", "run"))
    made = battery.unpivoted(stored(made, "facts"), ("generator", "run")).withColumn("id", F.concat_ws("-", "generator", "run"))
    real = long_of(spark, d).withColumn("id", F.concat_ws("-", "series_id", "start"))
    return real.select("stat", "id", "value"), made.select("stat", "generator", "id", "value")


def separation(spark: SparkSession, d: str) -> DataFrame:
    """The whole comparison with fitted generators: every window against 200 runs of each, with permutation tests."""
    return rounded(cells.permutation_test(*fitted_sides(spark, d), CELL, "stat", PERMUTATIONS, sql.SEED))


def all_reject_permuted(spark: SparkSession, d: str) -> DataFrame:
    return reports.all_rejecting(separation(spark, d))


def worst_case_table(spark: SparkSession, d: str) -> DataFrame:
    """Each statistic's least power, its bootstrap interval, and the same cell with windows that don't overlap."""
    real, made = fitted_sides(spark, d)
    worst = stored(reports.worst_cases(twosample.compared_cells(real, made, CELL, "stat")), "worst")
    names = F.broadcast(worst.select(*CELL))  # a row a statistic
    sides = real.join(names, "stat").withColumn("side", F.lit("a")).unionByName(made.join(names, CELL).withColumn("side", F.lit("b")))
    drawn = twosample.bootstrap_power(sides, CELL, ["id"], BOOTSTRAPS, sql.SEED)
    apart = twosample.compared_cells(long_of(spark, d, 1000).select("stat", "value"), made.drop("id"), CELL, "stat").select(*CELL, F.col("power").alias("power_apart"))
    return rounded(worst.join(drawn, CELL, "left").join(apart, CELL, "left"))


def power_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Power and its bootstrap interval of every statistic against every generator: 90 cells, 1,000 repeats."""
    real = long_of(spark, d).select("stat", F.concat_ws("-", "series_id", F.lpad(F.col("start").cast("string"), 12, "0")).alias("id"), "value")
    made = synthetic_long(spark, d).select("stat", "generator", F.lpad(F.col("run").cast("string"), 12, "0").alias("id"), "value")
    return rounded(twosample.cell_intervals(real, made, ["stat", "generator"], "stat", BOOTSTRAPS, sql.SEED))


def worst_case_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Each statistic's least power over the generators, its bootstrap interval, and the same cell with windows that don't overlap."""
    cells = stored(power_intervals(spark, d), "cells")
    apart = against(spark, d, stride=1000).select("stat", "generator", F.round("power", 6).alias("power_apart"))
    worst = reports.worst_cases(cells)
    return worst.join(cells.drop("power"), ["stat", "generator"]).join(apart, ["stat", "generator"], "left")


def interval_widths(spark: SparkSession, d: str) -> DataFrame:
    """Each statistic's mean width of the intervals over the generators."""
    return rounded(power_intervals(spark, d).groupBy("stat").agg(F.avg(F.col("ci_hi") - F.col("ci_lo")).alias("mean_width")))


def effective(spark: SparkSession, d: str) -> DataFrame:
    return rounded(robustness.effective_n(long_of(spark, d)))


def inflation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(robustness.interval_inflation(robustness.effective_n(long_of(spark, d))))


def strata(spark: SparkSession, d: str) -> DataFrame:
    made = synthetic_long(spark, d, ("garch_t",)).select("stat", "value")
    return rounded(robustness.by_stratum(long_of(spark, d), made))


def sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(robustness.tail_sweep(windows_of(spark, d), synthetic(spark, d, ("garch_t", "block_bootstrap"))))


def sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(battery.hill_sweep(windows_of(spark, d)))


def bands(spark: SparkSession, d: str) -> DataFrame:
    rows = sequence.cumulative_paths(windows_of(spark, d, stride=1000), ("series_id", "start")).withColumn("step", F.col("i") - F.col("start"))
    return rounded(sequence.path_bands(rows, ()))


def paths_like(spark: SparkSession, d: str) -> DataFrame:
    """Event returns of 990 rows a stretch as candidate paths: some short, some with runs of zeros made by rounding."""
    rows = series.returns(series.ev5(spark, d)).withColumn("r", F.when(F.col("i") % 1000 < 60, 0.0).otherwise(F.col("r")))
    return rows.select(F.col("series_id").alias("candidate"), F.floor(F.col("i") / 990).cast("long").alias("seed"), "i", "r")


def gates(spark: SparkSession, d: str) -> DataFrame:
    return calibration.gated(paths_like(spark, d))


def ends(spark: SparkSession, d: str) -> DataFrame:
    rows = windows_of(spark, d, stride=1000).select(F.col("series_id").alias("candidate"), F.col("start").alias("seed"), "i", "r")
    return calibration.deterministic(rows)


def drift_gate(spark: SparkSession, d: str) -> DataFrame:
    facts = facts_of(spark, d).select("series_id", "start", "drift")
    bounds = facts.agg(F.percentile("drift", F.lit(0.025)).alias("lo"), F.percentile("drift", F.lit(0.975)).alias("hi"))  # one row
    return rounded(facts.join(F.broadcast(bounds)).withColumn("inside", F.col("drift").between(F.col("lo"), F.col("hi"))))


def bounds(spark: SparkSession, d: str) -> DataFrame:
    """Windows as parameter sets, of statistics between their least and greatest values: those near an edge."""
    long = long_of(spark, d)
    edges = long.groupBy("stat").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    params = long.join(F.broadcast(edges), "stat").withColumn("model", F.concat_ws("-", "series_id", "start")).withColumnRenamed("stat", "param")
    return calibration.at_bound(params).select("model", F.array_join("at_bound", ",").alias("at_bound"))


def target_scale(spark: SparkSession, d: str) -> DataFrame:
    rows = series.measured(series.li6(spark, d))
    return rounded(calibration.target_and_scale(sliding(rows), tail(rows.where("series_id = 'AF'"))))


def rejections(spark: SparkSession, d: str) -> DataFrame:
    return calibration.rejections(calibration.gated(paths_like(spark, d)))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Runs of the generators as candidates with paths of ten seeds each."""
    made = synthetic(spark, d).withColumn("candidate", F.concat_ws("-", "generator", F.floor(F.col("run") / 10)))
    return stored(made.select("candidate", F.col("run").alias("seed"), "i", "r"), "paths")


def candidate_search(spark: SparkSession, d: str) -> DataFrame:
    """All candidates against the first series' last window: gates, quorum, drift, medians, losses, and the least first."""
    rows = series.measured(series.li6(spark, d))
    target = stored(calibration.target_and_scale(sliding(rows), tail(rows.where("series_id = 'AF'"))), "target")
    drift = calibration.drift_range(battery.evaluate(sliding(rows)))
    return rounded(calibration.search(candidates(spark, d), target, 10, drift))


def hold_out(spark: SparkSession, d: str) -> DataFrame:
    """generator, stat, fitted, held_out: medians over the first half of the runs, and over the others."""
    return rounded(calibration.hold_out(synthetic_long(spark, d), "generator", "run", RUNS // 2))


def model_report(spark: SparkSession, d: str) -> DataFrame:
    rows = series.measured(series.li6(spark, d))
    target = calibration.target_and_scale(sliding(rows), tail(rows.where("series_id = 'AF'")))
    made = synthetic_long(spark, d).withColumnRenamed("generator", "model")
    return rounded(reports.held_out(reports.model_stats(made, target), list(calibration.FITTED), ["drift"]))


def loss_table(spark: SparkSession, d: str) -> DataFrame:
    """Every window as a candidate against the means of all."""
    long = long_of(spark, d)
    target = long.groupBy("stat").agg(F.avg("value").alias("target"), F.stddev_pop("value").alias("scale"))
    return rounded(calibration.losses(long.withColumn("candidate", F.concat_ws("-", "series_id", "start")), target))


def frontier(spark: SparkSession, d: str) -> DataFrame:
    return calibration.frontier(loss_table(spark, d), 20)


def fits(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fitting.fit_windows(windows_of(spark, d)))


def whole_fits(spark: SparkSession, d: str) -> DataFrame:
    """GARCH and t parameters of every whole series; to three places, as far as the search goes."""
    fits = longfit.fit_series(series.measured(series.li6(spark, d)))
    return fits.select("series_id", *(F.round(c, 3).alias(c) for c in ("omega", "alpha", "beta", "t_df")))


def series_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """The likelihood of every whole series where the published fit starts, a return's mean."""
    points = [(1 - a - b, a, b) for a, b in longfit.STARTS]
    rows = longfit.likelihood_table(series.measured(series.ord5(spark, d)), points, chunk=1000)
    return rounded(rows.select("series_id", F.col("point").cast("int").alias("point"), "n", (F.col("f") / F.col("n")).alias("loss")))


def trailing(spark: SparkSession, d: str) -> DataFrame:
    """Mean and variance of the last 1 to 120 returns, as many as each row says."""
    rows = series.returns(series.li6(spark, d)).withColumn("m", (F.col("i") * 37 % 120 + 1).cast("long"))
    return rounded(sequence.trailing_slices(rows.select("series_id", "i", "r", "m"), "m", part=4096).drop("r"))


def search_draws(spark: SparkSession, d: str) -> DataFrame:
    """As many points as there are windows, spread evenly between the least and the greatest value of every statistic."""
    long = long_of(spark, d)
    windows = long.select("series_id", "start").distinct().count()
    edges = long.groupBy("stat").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = F.array(*(sobol.point(F.col("k"), dim, sql.SEED, "draws") for dim in range(len(sql.STATS))))
    points = spark.range(windows).select(F.col("id").alias("k")).select("k", F.posexplode(at).alias("dim", "at"))
    points = points.withColumn("stat", F.element_at(F.array(*map(F.lit, sorted(sql.STATS))), F.col("dim") + 1))
    return rounded(points.join(F.broadcast(edges), "stat").select("k", "stat", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("at")).alias("value")))


def generator_search(spark: SparkSession, d: str) -> DataFrame:
    """The generators' parameters that come nearest to the first series' last window: 32 draws and a pass of refinement from two
    starts, six seeds an evaluation, behind the gate of the real windows' drift. One row for each parameter."""
    rows = stored(series.measured(series.li6(spark, d)), "measured")
    windows = battery.evaluate(sliding(rows))
    target = stored(calibration.target_and_scale(sliding(rows), tail(rows.where("series_id = 'AF'"))), "target")
    judge = search.evaluated(stored(generators.pooled(rows), "pool"), target, 6, calibration.drift_range(windows))
    folder = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    found = search.search(spark, search.RANGES, judge, folder, "generators", 32, sql.SEED, starts=2)
    ranges = [(m, p, float(lo), float(hi)) for m, ps in search.RANGES.items() for p, (lo, hi, *_) in ps.items()]
    ranges = spark.createDataFrame(ranges, "model string, param string, lo double, hi double")
    params = found.select("model", "loss", "default_loss", "evaluations", F.explode_outer("params").alias("param", "value")).join(ranges, ["model", "param"], "left")
    bounds = calibration.at_bound(params.where("param IS NOT NULL")).select("model", F.array_join("at_bound", ",").alias("at_bound"))
    return rounded(params.join(bounds, "model", "left").select("model", "param", "value", "loss", "default_loss", "evaluations", "at_bound"))


SHARES = [0.0, 0.01, 0.025, 0.5, 0.975, 0.99, 1.0]


def price_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = series.table(spark, d, "lineitem").select("l_returnflag", "l_shipdate", F.col("l_extendedprice").cast("double").alias("price"))
    return rounded(sequence.percentiles(rows, ["l_returnflag"], "price", SHARES))


LAGS = [1, 5, 10, 25, 50, 100]


def smoothed_acf(spark: SparkSession, d: str) -> DataFrame:
    rows = series.returns(series.li6(spark, d))
    return rounded(sequence.smoothed_autocorrelations(rows, LAGS, F.abs("r"), part=4096))


def zero_shares(spark: SparkSession, d: str) -> DataFrame:
    return calibration.zero_share_gate(paths_like(spark, d))


def simplex(spark: SparkSession, d: str) -> DataFrame:
    """Quantity, discount and tax of an order line as weights."""
    rows = series.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 100).alias("w_a"), F.col("l_discount").alias("w_b"), F.col("l_tax").alias("w_c"))
    return rounded(calibration.on_simplex(rows, ["w_a", "w_b", "w_c"]))


def override(spark: SparkSession, d: str) -> DataFrame:
    """The range of every statistic in every series, its upper end replaced by the median in two of them."""
    edges = long_of(spark, d).groupBy(F.col("series_id").alias("model"), F.col("stat").alias("param")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.median("value").alias("middle"))
    edges = stored(edges, "edges")
    changes = edges.where("model IN ('AF', 'NO')").select("model", "param", F.lit(None).cast("double").alias("lo"), F.col("middle").alias("hi"))
    return rounded(calibration.overridden(edges.drop("middle"), changes))


def listed_labels(spark: SparkSession, d: str) -> DataFrame:
    listed = F.concat_ws(",", F.lit(" B side"), F.upper("lang"), F.lit(""), F.concat(F.lit("  "), F.col("source"), F.lit(" ")), F.when(F.col("doc_id") % 3 == 0, F.lit("a")))
    return series.table(spark, d, "documents").select("doc_id", F.array_join(text.labels(listed), "|").alias("labels"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    return series.table(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("body"))


def references(spark: SparkSession, d: str) -> DataFrame:
    """Page text with a list of references put after it, which is to go; a heading near the start stays."""
    body = F.concat(F.when(F.col("page_id") % 2 == 0, "x References y ").otherwise(""), text.strip_html(F.col("html")), F.lit(" References z"))
    return series.table(spark, d, "pages").select("page_id", text.strip_references(body).alias("body"))


def audited(spark: SparkSession, d: str) -> DataFrame:
    return text.audit(series.table(spark, d, "documents"), "doc_id", "text", WORDS, MENTION, SIMULATION)


def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = audited(spark, d)
    return rows.select("doc_id", "nchar", *(F.col("counts")[w].cast("bigint").alias(f"n_{w}") for w in WORDS), F.array_join("ge1", ",").alias("ge1"), F.array_join("ge3", ",").alias("ge3"))


def audit_stream(spark: SparkSession, d: str) -> DataFrame:
    """The audit of documents that arrive as files, four a batch; what the batches have written."""
    folder = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
    docs = series.table(spark, d, "documents").select("doc_id", "text")
    docs.repartition(12).write.parquet(f"{folder}/in")
    stream = audits.arriving(spark, f"{folder}/in", "doc_id long, text string", 4)
    audits.audit_stream(stream, f"{folder}/out", f"{folder}/checkpoint", categories=WORDS, mention=MENTION, simulation=SIMULATION).awaitTermination()
    rows = audits.results(spark, f"{folder}/out")
    return rows.select("doc_id", "nchar", *(F.col("counts")[w].cast("bigint").alias(f"n_{w}") for w in WORDS), F.array_join("ge1", ",").alias("ge1"), F.array_join("ge3", ",").alias("ge3"))


def audit_inclusion(spark: SparkSession, d: str) -> DataFrame:
    return audited(spark, d).select("doc_id", "sf_mention", "is_sim")


def audit_prevalence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(text.prevalence(audited(spark, d)))


def digest(spark: SparkSession, d: str) -> DataFrame:
    return series.digests(series.li3(spark, d))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """series_id, ts (seconds), close: the highest order price of a day for each priority; every seventh day is closed (null)."""
    rows = series.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("close"))
    ts = F.unix_date("day").cast("long") * 86400
    return rows.select("series_id", ts.alias("ts"), F.when(F.unix_date("day") % 7 != 0, F.col("close")).alias("close"))


def payload_returns(spark: SparkSession, d: str) -> DataFrame:
    """Daily closes as JSON payloads, written, scanned and turned into returns."""
    written = stored(series.as_payloads(daily(spark, d)), "payloads")
    return rounded(series.returns(series.parsed(series.require_rows(written, "payloads"))))


def loaded_returns(spark: SparkSession, d: str) -> DataFrame:
    """Daily closes as files of payloads, one folder a series, loaded by the data source and turned into returns."""
    folder = f"{shared_dir(spark)}/payload-files-{uuid.uuid4().hex}"
    made = series.as_payloads(daily(spark, d))
    made.repartition("series_id").write.partitionBy("series_id").text(folder)
    names = [r[0] for r in spark.read.text(folder).select("series_id").distinct().collect()]  # names of series
    spark.dataSource.register(loader.PayloadSource)
    source = spark.read.format("price_payloads").options(url=f"{folder}/series_id={{symbol}}", symbols=",".join(names))
    return rounded(series.returns(series.parsed(source.load())))


def payload_verified(spark: SparkSession, d: str) -> DataFrame:
    """The published fingerprint of every payload, held against those of the closes themselves, of which one is altered."""
    closes = daily(spark, d)
    found = series.line_digests(series.parsed(series.as_payloads(closes)))
    altered = closes.withColumn("close", F.when(F.col("series_id") == "1-URGENT", F.col("close") + 1).otherwise(F.col("close")))
    return series.verified(found, series.line_digests(series.parsed(series.as_payloads(altered))))


def sinks(spark: SparkSession, d: str) -> DataFrame:
    """Facts written whole as JSON, by series, one series replaced, and paths as single precision; read back and joined."""
    folder = f"{shared_dir(spark)}/sinks-{uuid.uuid4().hex}"
    facts = facts_of(spark, d).select("series_id", "start", "excess_kurtosis", "drift")
    results.save(facts, f"{folder}/whole", "json")
    whole = results.load(spark, f"{folder}/whole", "series_id string, start long, excess_kurtosis double, drift double", "json")
    results.save_part(whole, f"{folder}/parts", "series_id")
    results.save_part(whole.where("series_id = 'AF'").withColumn("drift", F.lit(0.0)), f"{folder}/parts", "series_id")
    parts = results.load(spark, f"{folder}/parts", "start long, excess_kurtosis double, drift double, series_id string")
    paths = windows_of(spark, d, stride=1000).select(F.col("series_id").alias("model"), F.lit(1).alias("version"), F.col("start").alias("seed"), F.col("i").alias("t"), F.round("r", 2).alias("r"))
    results.save_paths(paths, f"{folder}/paths")
    sums = spark.read.parquet(f"{folder}/paths").groupBy(F.col("model").alias("series_id")).agg(F.count("*").alias("path_rows"), F.sum(F.col("r").cast("double")).alias("path_sum"))
    return rounded(parts.join(sums.withColumn("path_sum", F.round("path_sum", 1)), "series_id"))


def scalar_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = series.table(spark, d, "lineitem")
    price = F.col("l_extendedprice").cast("double")
    a, b = scalars.capped_pair(F.col("l_discount").cast("double") * 8, F.col("l_tax").cast("double") * 8)
    name = F.concat_ws("/", "l_returnflag", "l_linestatus")
    rows = rows.select(
        "l_orderkey", "l_linenumber", scalars.whole(price / 8).alias("whole"), scalars.to_tick(price, 0.25).alias("tick"), scalars.to_tick(price / 1e6, 0.25).alias("least"),
        scalars.percent_steps(price, F.lit(1.5)).alias("steps"), a.alias("a"), b.alias("b"), scalars.safe_id(name).alias("id"), F.url_encode(name).alias("quoted"),
        scalars.short_title(F.repeat(name, 20)).alias("title"), F.timestamp_seconds(F.col("l_orderkey") * 86400).cast("date").alias("day"),
    )
    return rounded(rows)


def page_sources(spark: SparkSession, d: str) -> DataFrame:
    """Pages as fetched files: long ones give text, short ones fail. A text of an even page is held in a cache."""
    pages = series.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("doc_id"), "page_id", "html")
    cache = pages.where("page_id % 2 = 0").select("doc_id", F.col("html").alias("text"))
    fetched = pages.select("doc_id", F.lit("html").alias("kind"), F.encode("html", "utf-8").alias("content"))
    fetch = lambda rest: documents.decoded(fetched.join(rest, "doc_id", "left_semi"), 1500)
    return documents.read_through(pages.select("doc_id"), cache, fetch)


def document_packages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as source packages, compressed or archived, stored and decoded again."""
    held = stored(documents.as_packages(series.table(spark, d, "documents")), "packages")
    rows = documents.decoded(held)
    return rows.select("doc_id", "how", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


def document_source(spark: SparkSession, d: str) -> DataFrame:
    return page_sources(spark, d).select("doc_id", "how", F.length("text").cast("long").alias("n_chars"))


PHRASES = ("Fat tails and excess kurtosis.", "Volatility clustering is a stylized fact.", "Long memory; the Hurst exponent.", "The leverage effect.", "Gain/loss asymmetry.", "Lack of autocorrelation.",
           "Aggregational Gaussianity.", "Trading volume and volatility.", "A regime shift in an agent-based model.", "Stylised facts of an artificial market.", "An apple a day.")


def audit_categories(spark: SparkSession, d: str) -> DataFrame:
    """The nine categories in documents, each with two sentences put after it."""
    said = F.array(*map(F.lit, PHRASES))
    pick = lambda k: F.element_at(said, (F.pmod(F.col("doc_id") * k, F.lit(len(PHRASES))) + 1).cast("int"))
    docs = series.table(spark, d, "documents").select("doc_id", F.concat_ws(" ", "text", pick(1), pick(7)).alias("text"))
    rows = text.audit(docs, "doc_id", "text")
    return rows.select("doc_id", "sf_mention", "is_sim", *(F.col("counts")[c].cast("bigint").alias(c.replace("-", "_")) for c in text.CATEGORIES))


def resume(spark: SparkSession, d: str) -> DataFrame:
    """Windows still to do when those of even hundreds of starts are done."""
    wanted = windows_of(spark, d).select("series_id", "start").distinct()
    return results.unfinished(wanted, wanted.where("start % 500 = 0"), ["series_id", "start"])


def mid_ranks(spark: SparkSession, d: str) -> DataFrame:
    rows = series.table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_orderkey", F.col("l_quantity").alias("value"))
    ranks = sequence.mid_ranks(rows, ["l_returnflag"])
    return rounded(ranks.groupBy("l_returnflag", "value").agg(F.count("*").alias("n"), F.max("rank").alias("rank")))


def zero_runs(spark: SparkSession, d: str) -> DataFrame:
    return sequence.zero_runs(paths_like(spark, d), ("candidate", "seed"))


def power_pivot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.cross_table(against(spark, d), "power", list(NATIVE)))


def all_reject(spark: SparkSession, d: str) -> DataFrame:
    """By the large-sample bound on the distance, in place of permutations."""
    rows = against(spark, d)
    p = F.least(F.lit(1.0), 2 * F.exp(-2 * F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")) * F.col("ks") * F.col("ks")))
    return rounded(reports.all_rejecting(rows.withColumn("pvalue", p)))


def queries() -> dict:
    out = {
        "series_returns": returns_query("li6"), "series_order_returns": returns_query("ord5"), "series_region_returns": returns_query("reg5"), "series_event_returns": returns_query("ev5"),
        "windows_sliding": windows_query(250), "windows_nonoverlap": windows_query(1000), "flagship": lambda spark, d: flagship(spark, d),
        "fact_kurtosis": fact_query("excess_kurtosis"), "fact_skew": fact_query("gain_loss_asymmetry"), "fact_drift": fact_query("drift"), "fact_hill": fact_query("hill_right", "hill_left"),
        "fact_acf": fact_query("acf_return_1", "acf_abs_1", "acf_abs_20"), "fact_acf_decay": fact_query("acf_abs_decay"), "fact_ljung_box": fact_query("ljung_box_sq"),
        "fact_agg_gaussianity": fact_query("aggregational_gaussianity"), "fact_vol_of_vol": fact_query("vol_of_vol"), "fact_multiscaling": fact_query("multiscaling"),
        "fact_variance_ratio": fact_query("variance_ratio_20"), "fact_leverage": fact_query("leverage"), "battery_long": lambda spark, d: rounded(long_of(spark, d)),
        "battery_summary": lambda spark, d: rounded(battery.summary(long_of(spark, d))), "hill_sensitivity": sensitivity,
        "gen_garch": gen_garch, "real_vs_real": real_vs_real, "power_table": lambda spark, d: rounded(against(spark, d)), "perm_pvalue": permutation, "bootstrap_ci": bootstrap,
        "separation": separation, "power_intervals": power_intervals, "interval_widths": interval_widths, "effective_n": effective, "interval_inflation": inflation, "ks_per_series": strata, "tail_sweep": sweep, "cum_paths": bands, "zero_runs": zero_runs,
        "top3_stats": lambda spark, d: rounded(reports.top_stats(against(spark, d))), "worst_case_stat": lambda spark, d: rounded(reports.worst_cases(against(spark, d))),
        "all_reject": all_reject, "power_pivot": power_pivot, "validity_gates": gates, "deterministic_gate": ends, "drift_gate": drift_gate,
        "all_reject_permuted": all_reject_permuted, "worst_case_table": worst_case_table, "power_nonoverlap": lambda spark, d: rounded(against(spark, d, stride=1000)),
        "target_scale": target_scale, "rejection_counts": rejections, "candidate_search": candidate_search, "hold_out": hold_out, "model_report": model_report,
        "payload_returns": payload_returns, "loaded_returns": loaded_returns, "audit_stream": audit_stream, "payload_verified": payload_verified, "sink_roundtrip": sinks, "audit_categories": audit_categories, "scalar_rules": scalar_rules,
        "document_source": document_source, "document_packages": document_packages, "worst_case_intervals": worst_case_intervals, "fetch_accounting": lambda spark, d: documents.accounting(page_sources(spark, d)), "fit_windows": fits, "fit_series": whole_fits, "series_likelihood": series_likelihood, "trailing_slices": trailing, "smoothed_acf": smoothed_acf, "price_percentiles": price_percentiles, "zero_share_gate": zero_shares, "simplex_weights": simplex, "range_overrides": override, "audit_labels": listed_labels, "search_draws": search_draws, "generator_search": generator_search, "at_bound": bounds, "loss_table": loss_table, "frontier_topk": frontier,
        "audit_strip_html": html_text, "audit_strip_refs": references, "audit_counts": audit_counts, "audit_inclusion": audit_inclusion, "audit_prevalence": audit_prevalence,
        "payload_digest": digest, "resume_antijoin": resume, "mid_ranks": mid_ranks,
    }
    return out | {f"gen_{n}": generator_query(n) for n in NATIVE}


R6 = sql.r6
BATTERY = f"{sql.windows()}, {sql.facts()}"
REAL_SIDES = f"sam AS (SELECT stat, series_id, start, value, {sql.SPLIT} AS side FROM flong)"
SYNTHETIC = f"{sql.POOL}, gen AS MATERIALIZED ({sql.generated(NATIVE, RUNS, 1000)}), {sql.facts('gen', 'generator, run', 'g')}"
NAMES = "names AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in NATIVE) + "]) AS generator)"


def against_sql(stride: int = 250) -> str:
    return f"""WITH {sql.windows(stride=stride)}, {sql.facts()}, {SYNTHETIC}, {NAMES},
sam AS (SELECT stat, generator, 'a' AS side, value FROM flong, names UNION ALL SELECT stat, generator, 'b', value FROM glong), {sql.compared('stat, generator')}"""


AGAINST = against_sql()
PATHS = f"{sql.returns('ev5')}, pa AS (SELECT series_id AS candidate, i // 990 AS seed, i, CASE WHEN i % 1000 < 60 THEN 0 ELSE r END AS r FROM ret)"
ISLANDS = "isl AS (SELECT *, abs(r) < 1e-12 AS zero, i - row_number() OVER (PARTITION BY candidate, seed, abs(r) < 1e-12 ORDER BY i) AS island FROM pa), runs AS (SELECT candidate, seed, max(n) AS longest FROM (SELECT candidate, seed, zero, island, count(*) FILTER (WHERE zero) AS n FROM isl GROUP BY ALL) GROUP BY ALL)"
STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')"
COUNTED = "cnt AS (SELECT doc_id, text, " + ", ".join(f"len(regexp_extract_all(lower(text), '{p}')) AS n_{w}" for w, p in WORDS.items()) + " FROM documents)"


def at_least(n: int) -> str:
    found = ", ".join(f"CASE WHEN n_{w} >= {n} THEN '{w}' END" for w in WORDS)
    return f"coalesce(array_to_string(list_sort([x FOR x IN [{found}] IF x IS NOT NULL]), ','), '')"


def oracle_sql() -> dict[str, str]:
    returned = lambda s: f"WITH {sql.returns(s)} SELECT series_id, i, {R6('r')} AS r FROM ret"
    counted = lambda stride: f"WITH {sql.windows(stride=stride)} SELECT series_id, start, count(*) AS n, {R6('sum(r)')} AS total FROM w GROUP BY 1, 2"
    numbers = ", ".join(f"{R6(c)} AS {c}" for c in ("auc", "power", "ks"))
    out = {f"series_{k}returns": returned(s) for k, s in (("", "li6"), ("order_", "ord5"), ("region_", "reg5"), ("event_", "ev5"))}
    out |= {"windows_sliding": counted(250), "windows_nonoverlap": counted(1000)}
    six = ("excess_kurtosis", "acf_abs_1", "acf_abs_20", "leverage", "drift", "variance_ratio_20")
    out["flagship"] = f"WITH {sql.windows('li3')}, {sql.facts()} SELECT series_id, start, {', '.join(f'{R6(s)} AS {s}' for s in six)} FROM ffacts"
    out |= {
        f"fact_{name}": sql.fact(*stats)
        for name, stats in {
            "kurtosis": ["excess_kurtosis"], "skew": ["gain_loss_asymmetry"], "drift": ["drift"], "hill": ["hill_right", "hill_left"], "acf": ["acf_return_1", "acf_abs_1", "acf_abs_20"], "acf_decay": ["acf_abs_decay"],
            "ljung_box": ["ljung_box_sq"], "agg_gaussianity": ["aggregational_gaussianity"], "vol_of_vol": ["vol_of_vol"], "multiscaling": ["multiscaling"], "variance_ratio": ["variance_ratio_20"], "leverage": ["leverage"],
        }.items()
    }
    out["battery_long"] = f"WITH {BATTERY} SELECT series_id, start, stat, {R6('value')} AS value FROM flong"
    out["battery_summary"] = f"WITH {BATTERY} SELECT stat, count(value) AS n, {R6('median(value)')} AS median, {R6('quantile_cont(value, 0.025)')} AS lo, {R6('quantile_cont(value, 0.975)')} AS hi, {R6('stddev_pop(value)')} AS scale FROM flong GROUP BY stat"
    hills = " UNION ALL ".join(f"SELECT series_id, start, '{s}' AS side, {f}::DOUBLE AS frac, {R6(sql.hill(s, f))} AS hill FROM rk GROUP BY series_id, start" for s in ("left", "right") for f in ("0.025", "0.05", "0.1"))
    out["hill_sensitivity"] = f"WITH {sql.windows()}, rk AS ({sql.ranked('w', 'series_id, start')}) {hills}"
    for n in NATIVE:
        out[f"gen_{n}"] = f"WITH {sql.returns('li6')}, {sql.POOL}, gen AS ({sql.generator(n, 20, 100)}) SELECT generator, run, i, {R6('r')} AS r FROM gen"
    out["gen_garch"] = f"SELECT generator, run, i, {R6('r')} AS r FROM ({sql.generator('garch_norm', 4, 100)})"
    out["real_vs_real"] = f"WITH {BATTERY}, {REAL_SIDES}, {sql.compared('stat')} SELECT stat, n_a, n_b, {numbers} FROM cmp"
    out["power_table"] = f"{AGAINST} SELECT stat, generator, n_a, n_b, {numbers} FROM cmp"
    drawn = lambda s, size: f"d{s} AS (SELECT rep, pos, count(*) AS w FROM (SELECT rep, floor({sql.uniform(str(sql.SEED), chr(39) + 'boot' + chr(39), 'rep', chr(39) + s + chr(39), 'slot')} * n)::BIGINT AS pos FROM (SELECT n, unnest(range(n)) AS slot FROM {size}), range({BOOTSTRAPS}) AS p(rep)) GROUP BY rep, pos)"
    cells = f"""{AGAINST}, ra AS (SELECT stat, value, dense_rank() OVER (ORDER BY series_id || '-' || lpad(start::VARCHAR, 12, '0')) - 1 AS pos FROM flong), rb AS (SELECT stat, generator, value, run AS pos FROM glong),
na AS (SELECT max(pos) + 1 AS n FROM ra), nb AS (SELECT max(pos) + 1 AS n FROM rb), {drawn('a', 'na')}, {drawn('b', 'nb')},
wb AS MATERIALIZED (SELECT stat, generator, rep, value, w FROM rb JOIN db USING (pos)), wa AS MATERIALIZED (SELECT stat, generator, rep, value, w FROM ra JOIN da USING (pos), names),
al AS (SELECT stat, generator, rep, value, sum(wa) AS wa, sum(wb) AS wb FROM (SELECT stat, generator, rep, value, w AS wa, 0 AS wb FROM wa UNION ALL SELECT stat, generator, rep, value, 0, w FROM wb) GROUP BY ALL),
iu AS (SELECT stat, generator, rep, wa, wb, sum(wb) OVER (PARTITION BY stat, generator, rep ORDER BY value) AS cb FROM al),
it AS (SELECT stat, generator, rep, sum(wa) AS ta, sum(wb) AS tb, sum(wa * cb) AS hit, sum(wa * wb) AS tie FROM iu GROUP BY ALL),
iv AS (SELECT stat, generator, quantile_cont(power, 0.025) AS ci_lo, quantile_cont(power, 0.975) AS ci_hi FROM (SELECT stat, generator, 2 * abs((2 * ta * tb - 2 * hit + tie)::DOUBLE / (2 * ta * tb) - 0.5) AS power FROM it) GROUP BY ALL)"""
    out["power_intervals"] = f"{cells} SELECT stat, generator, {R6('power')} AS power, {R6('ci_lo')} AS ci_lo, {R6('ci_hi')} AS ci_hi FROM cmp JOIN iv USING (stat, generator)"
    out["worst_case_intervals"] = f"""SELECT stat, generator, power, ci_lo, ci_hi, power_apart FROM (SELECT *, row_number() OVER (PARTITION BY stat ORDER BY power, generator) AS place FROM ({out['power_intervals']}) WHERE power IS NOT NULL)
LEFT JOIN (SELECT stat, generator, power AS power_apart FROM ({against_sql(1000)} SELECT stat, generator, {R6('power')} AS power FROM cmp)) USING (stat, generator) WHERE place = 1"""
    out["interval_widths"] = f"{cells} SELECT stat, {R6('avg(round(ci_hi, 6) - round(ci_lo, 6))')} AS mean_width FROM iv GROUP BY stat"
    out["perm_pvalue"] = f"""WITH {BATTERY}, {REAL_SIDES}, fnd AS (SELECT * FROM sam WHERE value IS NOT NULL),
per AS (SELECT *, count(*) FILTER (WHERE side = 'a') OVER (PARTITION BY stat) AS k FROM fnd),
dealt AS (SELECT stat, perm, value, CASE WHEN row_number() OVER (PARTITION BY stat, perm ORDER BY md5(concat_ws('|', {sql.SEED}, 'perm', perm, side, series_id, start)), side, series_id, start) <= k THEN 'a' ELSE 'b' END AS side FROM per, range({PERMUTATIONS}) AS p(perm)),
{sql.compared('stat', 'fnd', 'obs')}, {sql.compared('stat, perm', 'dealt', 'prm')}
SELECT stat, {R6('any_value(obsmp.ks)')} AS ks, {R6(f'(count(*) FILTER (WHERE prmmp.gap >= obsmp.gap) + 1) / ({PERMUTATIONS} + 1.0::DOUBLE)')} AS pvalue, {R6('quantile_cont(prmmp.ks, 0.95)')} AS null95 FROM prmmp JOIN obsmp USING (stat) GROUP BY stat"""
    out["bootstrap_ci"] = f"""WITH {BATTERY}, {REAL_SIDES}, fnd AS (SELECT *, row_number() OVER (PARTITION BY stat, side ORDER BY series_id, start) - 1 AS pos FROM sam WHERE value IS NOT NULL),
siz AS (SELECT stat, side, count(*) AS n FROM fnd GROUP BY ALL),
drw AS (SELECT stat, side, rep, floor({sql.uniform(str(sql.SEED), "'boot'", 'stat', 'rep', 'side', 'slot')} * n)::BIGINT AS pos FROM (SELECT stat, side, n, unnest(range(n)) AS slot FROM siz), range({BOOTSTRAPS}) AS p(rep)),
smp AS (SELECT stat, rep, side, value FROM drw JOIN fnd USING (stat, side, pos)), {sql.compared('stat, rep', 'smp')}
SELECT stat, {R6('quantile_cont(power, 0.025)')} AS ci_lo, {R6('quantile_cont(power, 0.975)')} AS ci_hi FROM cmp GROUP BY stat"""
    effective_cte = f"""WITH {BATTERY}, grp AS (SELECT stat, avg(m) AS m, avg(wv) AS wv FROM (SELECT stat, start, count(*) AS m, var_pop(value) AS wv FROM flong GROUP BY 1, 2) WHERE m > 1 GROUP BY stat),
tot AS (SELECT stat, count(*) AS n, var_pop(value) AS tv FROM flong GROUP BY stat),
eff AS (SELECT stat, n, CASE WHEN tv > 0 AND m IS NOT NULL THEN 1 + (m - 1) * least(greatest(1 - wv / tv, 0), 0.99) ELSE 1 END AS deff FROM tot LEFT JOIN grp USING (stat))"""
    out["effective_n"] = f"{effective_cte} SELECT stat, n, {R6('deff')} AS deff, {R6('n / deff')} AS n_eff FROM eff"
    out["interval_inflation"] = f"{effective_cte} SELECT {R6('median(n / deff)')} AS median_n_eff, {R6('sqrt(max(n) / median(n / deff))')} AS inflation FROM eff"
    block = f"{sql.POOL}, gen AS ({sql.generator('garch_t', RUNS, 1000)}), {sql.facts('gen', 'generator, run', 'g')}"
    out["ks_per_series"] = f"""WITH {BATTERY}, {block}, rl AS (SELECT stat, series_id AS stratum, value FROM flong UNION ALL SELECT stat, 'all', value FROM flong),
sam AS (SELECT stat, stratum, 'a' AS side, value FROM rl UNION ALL SELECT stat, stratum, 'b', value FROM glong, (SELECT DISTINCT stratum FROM rl)), {sql.compared('stat, stratum')} SELECT stat, stratum, n_a, {R6('ks')} AS ks FROM cmp"""
    cases = [(s, f) for s in ("left", "right") for f in ("0.025", "0.05", "0.1")]
    real = " UNION ALL ".join(f"SELECT '{s}' AS tail, {f}::DOUBLE AS frac, {sql.hill(s, f)} AS value FROM rk GROUP BY series_id, start" for s, f in cases)
    made = " UNION ALL ".join(f"SELECT generator, '{s}' AS tail, {f}::DOUBLE AS frac, {sql.hill(s, f)} AS value FROM gk GROUP BY generator, run" for s, f in cases)
    out["tail_sweep"] = f"""WITH {sql.windows()}, {sql.POOL}, gen AS ({sql.generated(('garch_t', 'block_bootstrap'), RUNS, 1000)}), rk AS ({sql.ranked('w', 'series_id, start')}), gk AS ({sql.ranked('gen', 'generator, run')}),
rl AS ({real}), sy AS ({made}), sam AS (SELECT tail, frac, generator, 'a' AS side, value FROM rl, (SELECT DISTINCT generator FROM gen) UNION ALL SELECT tail, frac, generator, 'b', value FROM sy), {sql.compared('tail, frac, generator')}
SELECT tail, frac, generator, {R6('ks')} AS ks, {R6('md')} AS real_median FROM cmp JOIN (SELECT tail, frac, median(value) AS md FROM rl GROUP BY ALL) USING (tail, frac)"""
    out["cum_paths"] = f"""WITH {sql.windows(stride=1000)}, cp AS (SELECT i - start AS step, sum(r) OVER (PARTITION BY series_id, start ORDER BY i) AS path FROM w)
SELECT step, count(*) AS paths, {R6('median(path)')} AS median, {R6('quantile_cont(path, 0.01)')} AS lo, {R6('quantile_cont(path, 0.99)')} AS hi FROM cp GROUP BY step"""
    out["price_percentiles"] = " UNION ALL ".join(f"SELECT l_returnflag, {p}::DOUBLE AS share, {R6(f'quantile_cont(l_extendedprice::DOUBLE, {p})')} AS value FROM lineitem GROUP BY 1" for p in SHARES)
    near = ", ".join(f"({k}, {j})" for k in LAGS for j in (k - 1, k, k + 1) if j > 0)
    every = sorted({j for k in LAGS for j in (k - 1, k, k + 1) if j > 0})
    out["smoothed_acf"] = f"""WITH {sql.returns('li6')}, cx AS (SELECT series_id, i, abs(r) - avg(abs(r)) OVER (PARTITION BY series_id) AS x FROM ret),
lx AS (SELECT series_id, x, {', '.join(f'lag(x, {j}) OVER o AS x{j}' for j in every)} FROM cx WINDOW o AS (PARTITION BY series_id ORDER BY i)),
ac AS (SELECT series_id, [{', '.join(f'sum(x * x{j}) / sum(x * x)' for j in every)}] AS a FROM lx GROUP BY 1),
un AS (SELECT series_id, unnest(a) AS acf, unnest({every}) AS near FROM ac)
SELECT series_id, lag, {R6('avg(acf)')} AS acf FROM un JOIN (SELECT * FROM (VALUES {near}) AS v(lag, near)) USING (near) GROUP BY series_id, lag"""
    out["zero_share_gate"] = f"WITH {PATHS} SELECT candidate, seed, CASE WHEN avg((abs(r) < 1e-12)::INT) > 0.03 THEN 'zeros' END AS reason FROM pa GROUP BY candidate, seed"
    weights = "l_quantity / 100 AS a, l_discount AS b, l_tax AS c"
    out["simplex_weights"] = f"SELECT l_orderkey, l_linenumber, {', '.join(f'{R6(w + ' / nullif(a + b + c, 0)')} AS w_{w}' for w in 'abc')} FROM (SELECT l_orderkey, l_linenumber, {weights} FROM lineitem)"
    upper = "CASE WHEN series_id IN ('AF', 'NO') THEN median(value) ELSE max(value) END"
    out["range_overrides"] = f"WITH {BATTERY} SELECT series_id AS model, stat AS param, {R6('min(value)')} AS lo, {R6(upper)} AS hi FROM flong GROUP BY series_id, stat"
    out["audit_labels"] = "SELECT doc_id, array_to_string(list_sort(list_filter(list_transform(string_split(concat_ws(',', ' B side', upper(lang), '', '  ' || source || ' ', CASE WHEN doc_id % 3 = 0 THEN 'a' END), ','), lambda x: lower(trim(x))), lambda x: x <> '')), '|') AS labels FROM documents"
    out["trailing_slices"] = f"""WITH {sql.returns('li6')}, ms AS (SELECT *, i * 37 % 120 + 1 AS m FROM ret)
SELECT series_id, a.i, any_value(a.m) AS m, {R6('avg(b.r)')} AS mean, {R6('var_pop(b.r)')} AS variance FROM ms a JOIN ret b USING (series_id) WHERE b.i > a.i - a.m AND b.i <= a.i GROUP BY series_id, a.i"""
    dims = ", ".join(f"({dim}, '{stat}')" for dim, stat in enumerate(sorted(sql.STATS)))
    where = "CASE dim " + " ".join(f"WHEN {dim} THEN {sobol.sql_point('k', dim, str(sql.SEED), chr(39) + 'draws' + chr(39))}" for dim in range(len(sql.STATS))) + " END"
    out["search_draws"] = f"""WITH {BATTERY}, ed AS (SELECT stat, min(value) AS lo, max(value) AS hi FROM flong GROUP BY stat), dm AS (SELECT * FROM (VALUES {dims}) AS v(dim, stat)),
sz AS (SELECT unnest(range(0, (SELECT count(DISTINCT (series_id, start)) FROM flong)))::BIGINT AS k)
SELECT k, stat, {R6(f'lo + (hi - lo) * {where}')} AS value FROM sz, dm JOIN ed USING (stat)"""
    starts = ", ".join(f"({k}, {1 - a - b}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in enumerate(longfit.STARTS))
    out["series_likelihood"] = f"""WITH RECURSIVE {sql.returns('ord5')}, pt AS (SELECT * FROM (VALUES {starts}) AS v(point, o, a, b)), ab AS (SELECT series_id, count(*) AS n, var_pop(r) AS v FROM ret GROUP BY 1),
sq AS MATERIALIZED (SELECT series_id, i, r * r AS q FROM ret),
st AS (SELECT series_id, point, o, a, b, 0::BIGINT AS i, v AS s FROM ab, pt UNION ALL SELECT st.series_id, point, o, a, b, st.i + 1, o + a * q + b * s FROM st JOIN sq ON sq.series_id = st.series_id AND sq.i = st.i)
SELECT series_id, point, n, {R6('sum(ln(s) + q / s) / n')} AS loss FROM st JOIN sq USING (series_id, i) JOIN ab USING (series_id) GROUP BY series_id, point, n"""
    out["zero_runs"] = f"WITH {PATHS}, {ISLANDS} SELECT candidate, seed, longest FROM runs"
    out["top3_stats"] = f"{AGAINST}, pl AS (SELECT *, row_number() OVER (PARTITION BY generator ORDER BY power DESC NULLS LAST, stat DESC)::INT AS place FROM cmp) SELECT generator, place, stat, {R6('power')} AS power FROM pl WHERE place <= 3"
    out["worst_case_stat"] = f"{AGAINST} SELECT stat, generator, {R6('power')} AS power FROM (SELECT *, row_number() OVER (PARTITION BY stat ORDER BY power, generator) AS place FROM cmp WHERE power IS NOT NULL) WHERE place = 1"
    out["all_reject"] = f"""{AGAINST}, pv AS (SELECT stat, least(1.0, 2 * exp(-2.0::DOUBLE * n_a * n_b / (n_a + n_b) * ks * ks)) AS p FROM cmp)
SELECT stat, {R6('max(p)')} AS max_pvalue FROM pv GROUP BY stat HAVING max(p) < 0.05 AND count(p) = count(*)"""
    worst = lambda n: R6(f"max(power) FILTER (WHERE generator = '{n}')")
    out["power_pivot"] = f"{AGAINST} SELECT stat, {', '.join(f'{worst(n)} AS {n}' for n in NATIVE)} FROM cmp GROUP BY stat"
    out["validity_gates"] = f"""WITH {PATHS}, {ISLANDS}, bk AS (SELECT *, row_number() OVER (PARTITION BY candidate, seed ORDER BY i DESC) AS back FROM pa),
ab AS (SELECT candidate, seed, count(*) AS n, stddev_pop(r) AS sd, stddev_pop(r) FILTER (WHERE back <= 50) AS tsd FROM bk GROUP BY ALL)
SELECT candidate, seed, CASE WHEN n < 900 THEN 'short' WHEN sd <= 0 THEN 'constant' WHEN tsd < 1e-9 THEN 'stopped' WHEN longest > 50 THEN 'zero run' END AS reason FROM ab JOIN runs USING (candidate, seed)"""
    out["rejection_counts"] = f"SELECT candidate, reason, count(*) AS paths FROM ({out['validity_gates']}) WHERE reason IS NOT NULL GROUP BY ALL"
    out["deterministic_gate"] = f"""WITH {sql.windows(stride=1000)}, en AS (SELECT series_id, start, sum(r) / stddev_pop(r) AS e, count(*) AS n FROM w GROUP BY ALL)
SELECT series_id AS candidate, count(*) >= 5 AND stddev_pop(e) / sqrt(max(n)) < 0.02 AS "deterministic" FROM en GROUP BY series_id"""
    out["drift_gate"] = f"WITH {BATTERY}, bd AS (SELECT quantile_cont(drift, 0.025) AS lo, quantile_cont(drift, 0.975) AS hi FROM ffacts) SELECT series_id, start, {R6('drift')} AS drift, {R6('lo')} AS lo, {R6('hi')} AS hi, drift BETWEEN lo AND hi AS inside FROM ffacts, bd"
    out["at_bound"] = f"""WITH {BATTERY}, t AS (SELECT series_id || '-' || start AS model, stat AS param, value, min(value) OVER (PARTITION BY stat) AS lo, max(value) OVER (PARTITION BY stat) AS hi FROM flong)
SELECT model, coalesce(array_to_string(list_sort(list_distinct(list(param) FILTER (WHERE hi > lo AND ((value - lo) / (hi - lo) <= 0.02 OR (value - lo) / (hi - lo) >= 0.98)))), ','), '') AS at_bound FROM t GROUP BY model"""
    last = f"lw AS (SELECT series_id, n - 1000 AS start, i, r FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM ret WHERE series_id = 'AF') WHERE i >= n - 1000), {sql.facts('lw', 'series_id, start', 'l')}"
    target = f"{BATTERY}, {last}, tgt AS (SELECT l.stat, any_value(l.value) AS target, CASE WHEN count(f.value) = count(*) THEN stddev_pop(f.value) END AS scale FROM llong l JOIN flong f ON f.stat = l.stat GROUP BY l.stat)"
    out["target_scale"] = f"WITH {target} SELECT stat, {R6('target')} AS target, {R6('scale')} AS scale FROM tgt"
    out["power_nonoverlap"] = f"{against_sql(1000)} SELECT stat, generator, n_a, n_b, {numbers} FROM cmp"
    half = lambda op: R6(f"median(value) FILTER (WHERE run {op} {RUNS // 2})")
    out["hold_out"] = f"WITH {sql.returns('li6')}, {SYNTHETIC} SELECT generator, stat, {half('<')} AS fitted, {half('>=')} AS held_out FROM glong GROUP BY ALL"
    role = "CASE WHEN stat IN (" + ", ".join(f"'{x}'" for x in calibration.FITTED) + ") THEN 'fitted' WHEN stat = 'drift' THEN 'gate' ELSE 'held_out' END"
    out["model_report"] = f"""WITH {target}, {SYNTHETIC}, md AS (SELECT generator AS model, stat, median(value) AS median, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM glong GROUP BY ALL)
SELECT model, stat, {R6('median')} AS median, {R6('lo')} AS lo, {R6('hi')} AS hi, {R6('target')} AS target, {R6('(median - target) / nullif(scale, 0)')} AS z, {role} AS role FROM md JOIN tgt USING (stat)"""
    chosen = ", ".join(f"'{x}'" for x in calibration.FITTED)
    out["candidate_search"] = f"""WITH {target}, {SYNTHETIC}, cl AS (SELECT generator || '-' || (run // 10) AS candidate, run, stat, value FROM glong),
bd AS (SELECT quantile_cont(drift, 0.025) AS lo, quantile_cont(drift, 0.975) AS hi FROM ffacts),
en AS (SELECT generator || '-' || (run // 10) AS candidate, run, sum(r) / nullif(stddev_pop(r), 0) AS e, count(*) AS n FROM gen GROUP BY ALL),
dt AS (SELECT candidate, count(*) >= 5 AND stddev_pop(e) / sqrt(max(n)) < 0.02 AS det FROM en GROUP BY candidate),
jd AS (SELECT candidate, CASE WHEN NOT coalesce(median(value) BETWEEN any_value(lo) AND any_value(hi), false) THEN 'drift' WHEN any_value(det) THEN 'deterministic' END AS reason FROM cl JOIN dt USING (candidate), bd WHERE stat = 'drift' GROUP BY candidate),
ms AS (SELECT candidate, stat, CASE WHEN count(value) = count(*) THEN median(value) END AS value FROM cl WHERE stat IN ({chosen}) GROUP BY ALL),
cs AS (SELECT candidate, CASE WHEN count((value - target) / scale) = 3 THEN sum(pow((value - target) / scale, 2)) END AS loss FROM ms JOIN tgt USING (stat) GROUP BY candidate)
SELECT candidate, CASE WHEN reason IS NULL THEN {R6('loss')} END AS loss, reason FROM cs JOIN jd USING (candidate)"""
    out["scalar_rules"] = f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS p, l_discount::DOUBLE * 8 AS x, l_tax::DOUBLE * 8 AS y, l_returnflag || '/' || l_linestatus AS name FROM lineitem)
SELECT l_orderkey, l_linenumber, round_even(p / 8, 0)::BIGINT AS whole, {R6('greatest(round_even(p / 0.25::DOUBLE, 0) * 0.25::DOUBLE, 0.25::DOUBLE)')} AS tick, {R6('greatest(round_even(p / 1000000 / 0.25::DOUBLE, 0) * 0.25::DOUBLE, 0.25::DOUBLE)')} AS least,
{R6('100 * (p - 1.5::DOUBLE)')} AS steps, {R6('CASE WHEN x + y > 0.95::DOUBLE THEN x * (0.95::DOUBLE / (x + y)) ELSE x END')} AS a, {R6('CASE WHEN x + y > 0.95::DOUBLE THEN y * (0.95::DOUBLE / (x + y)) ELSE y END')} AS b,
replace(name, '/', '_') AS id, replace(url_encode(name), '%20', '+') AS quoted, substr(repeat(name, 20), 1, 110) AS title, DATE '1970-01-01' + l_orderkey::INT AS day FROM t"""
    fetched = f"SELECT page_id::VARCHAR AS doc_id, CASE WHEN page_id % 2 = 0 AND strlen(html) > 2000 THEN 'cached' WHEN length(html) > 1500 THEN 'html' ELSE 'fail' END AS how, html, {STRIPPED} AS body FROM pages"
    flat = r"regexp_replace(text, '\s+', ' ', 'g')"
    out["document_packages"] = f"SELECT doc_id::VARCHAR AS doc_id, CASE WHEN strlen(text) > 1000 THEN 'compressed' ELSE 'package' END AS how, length({flat}) AS n_chars, sha256({flat}) AS sha256 FROM documents"
    out["document_source"] = f"SELECT doc_id, how, CASE how WHEN 'cached' THEN length(html) WHEN 'html' THEN length(body) END AS n_chars FROM ({fetched})"
    out["fetch_accounting"] = f"SELECT how, count(*) AS documents FROM ({fetched}) GROUP BY how"
    dailies = """cl AS (SELECT o_orderpriority AS series_id, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS day, max(o_totalprice) AS close FROM orders GROUP BY 1, 2),
op AS (SELECT * FROM cl WHERE day % 7 <> 0)"""
    out["payload_returns"] = f"""WITH {dailies}, lp AS (SELECT series_id, day, CASE WHEN close > 0 THEN ln(close) END AS v FROM op), df AS (SELECT series_id, day, v - lag(v) OVER (PARTITION BY series_id ORDER BY day) AS r FROM lp)
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS i, {R6('r / stddev_pop(r) OVER (PARTITION BY series_id)')} AS r FROM df WHERE r IS NOT NULL"""
    out["loaded_returns"] = out["payload_returns"]
    out["payload_verified"] = f"""WITH {dailies} SELECT series_id, count(*) AS n, sha256(string_agg((day * 86400)::VARCHAR || ',' || printf('%.6f', close), chr(10) ORDER BY day)) AS sha256, series_id <> '1-URGENT' AS ok FROM op GROUP BY series_id"""
    out["sink_roundtrip"] = f"""WITH {BATTERY}, ap AS (SELECT series_id, count(*) AS path_rows, round(sum(round(r, 2)::FLOAT::DOUBLE), 1) + 0.0 AS path_sum FROM w WHERE start % 1000 = 0 GROUP BY series_id)
SELECT series_id, start, {R6('excess_kurtosis')} AS excess_kurtosis, CASE WHEN series_id = 'AF' THEN 0.0 ELSE {R6('drift')} END AS drift, path_rows, path_sum FROM ffacts JOIN ap USING (series_id)"""
    said = "[" + ", ".join(f"'{x}'" for x in PHRASES) + "]"
    pick = lambda k: f"{said}[(doc_id * {k} % {len(PHRASES)}) + 1]"
    found = ", ".join(f"len(regexp_extract_all(lower(body), '{p}')) AS {c.replace('-', '_')}" for c, p in text.CATEGORIES.items())
    out["audit_categories"] = f"""WITH bd AS (SELECT doc_id, concat_ws(' ', text, {pick(1)}, {pick(7)}) AS body FROM documents)
SELECT doc_id, regexp_matches(body, '(?i){text.MENTION}') AS sf_mention, regexp_matches(body, '(?i){text.SIMULATION}') AS is_sim, {found} FROM bd"""
    fitted = ", ".join(f"'{s}'" for s in calibration.FITTED)
    losses = f"""WITH {BATTERY}, tg AS (SELECT stat, avg(value) AS target, stddev_pop(value) AS scale FROM flong GROUP BY stat),
ls AS (SELECT series_id || '-' || start AS candidate, round(sum(pow((value - target) / scale, 2)), 6) + 0.0 AS loss FROM flong JOIN tg USING (stat) WHERE stat IN ({fitted}) GROUP BY 1)"""
    out["loss_table"] = f"{losses} SELECT candidate, loss FROM ls"
    out["frontier_topk"] = f"{losses} SELECT candidate, loss FROM ls ORDER BY loss, candidate LIMIT 20"
    out["audit_strip_html"] = f"SELECT page_id, {STRIPPED} AS body FROM pages"
    out["audit_strip_refs"] = f"SELECT page_id, (CASE WHEN page_id % 2 = 0 THEN 'x References y ' ELSE '' END) || {STRIPPED} || ' ' AS body FROM pages"
    out["audit_counts"] = f"WITH {COUNTED} SELECT doc_id, length(text) AS nchar, {', '.join(f'n_{w}' for w in WORDS)}, {at_least(1)} AS ge1, {at_least(3)} AS ge3 FROM cnt"
    out["audit_stream"] = out["audit_counts"]
    flags = f"regexp_matches(text, '(?i){MENTION}') AS sf_mention, regexp_matches(text, '(?i){SIMULATION}') AS is_sim"
    out["audit_inclusion"] = f"SELECT doc_id, {flags} FROM documents"
    shares = " UNION ALL ".join(f"SELECT '{w}' AS category, count(*) AS docs, {R6(f'avg((n_{w} >= 1)::INT)')} AS share_ge1, {R6(f'avg((n_{w} >= 3)::INT)')} AS share_ge3 FROM inc" for w in WORDS)
    out["audit_prevalence"] = f"WITH {COUNTED}, inc AS (SELECT * FROM (SELECT *, {flags} FROM cnt) WHERE sf_mention AND is_sim) {shares}"
    out["payload_digest"] = f"""WITH src AS ({sql.SOURCES['li3']}), dy AS (SELECT series_id, ts::DATE AS day, count(*) AS n, sha256(string_agg((round_even(price * 100, 0)::BIGINT)::VARCHAR, chr(10) ORDER BY o)) AS part FROM src WHERE price IS NOT NULL GROUP BY 1, 2)
SELECT series_id, sum(n)::BIGINT AS n, sha256(string_agg(part, chr(10) ORDER BY day)) AS sha256 FROM dy GROUP BY 1"""
    out["resume_antijoin"] = f"WITH {sql.windows()} SELECT DISTINCT series_id, start FROM w WHERE start % 500 <> 0"
    out["mid_ranks"] = "WITH rk AS (SELECT l_returnflag, l_quantity AS value, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS rank FROM lineitem) SELECT l_returnflag, value, count(*) AS n, max(rank) AS rank FROM rk GROUP BY 1, 2"
    return out
