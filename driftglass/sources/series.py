"""Series: prices from tables or JSON payloads, and their standardised log returns.

A price table has series_id, day, order (a struct that sorts a series without ties), price. Ordinals and differences are
made within days, in one pass, and carried over from day to day by a small table of one row per series and day, so a series of
any length is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAYLOAD = "chart STRUCT<result: ARRAY<STRUCT<timestamp: ARRAY<BIGINT>, indicators: STRUCT<quote: ARRAY<STRUCT<close: ARRAY<DOUBLE>>>>>>>"


class NoSourceData(Exception):
    """A source has no rows to make series of."""


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if not df.take(1):
        raise NoSourceData(f"{what} has no rows")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def priced(df: DataFrame, series: Column, price: Column, ts: str, *ties: str) -> DataFrame:
    return df.select(series.alias("series_id"), F.to_date(ts).alias("day"), F.struct(ts, *ties).alias("order"), price.cast("double").alias("price"))


LINE_TIES = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def li6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return priced(rows, F.concat("l_returnflag", "l_linestatus"), F.col("l_extendedprice"), "l_shipdate", *LINE_TIES)


def li3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(table(spark, sf_dir, "lineitem"), F.col("l_returnflag"), F.col("l_extendedprice"), "l_shipdate", *LINE_TIES)


def ord5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.col("o_totalprice"), "o_orderdate", "o_orderkey")


def reg5(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")  # 25 rows
    homes = customer.join(F.broadcast(places), customer.c_nationkey == places.n_nationkey).select("c_custkey", "r_name")
    return priced(orders.join(homes, orders.o_custkey == homes.c_custkey), F.col("r_name"), F.col("o_totalprice"), "o_orderdate", "o_orderkey")


def ev5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of events less one cent, some of which are zero and have no logarithm."""
    return priced(table(spark, sf_dir, "events"), F.col("event_type"), F.round(F.col("value") - 0.01, 2), "ts", "event_id")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Prices of a folder of JSON payloads, one series for each file, named by its stem."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return parsed(rows.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("series_id"), F.col("value").alias("payload")))


def parsed(rows: DataFrame) -> DataFrame:
    """Prices of rows(series_id, payload). Null closes stay null."""
    rows = rows.select("series_id", F.from_json("payload", PAYLOAD)["chart"]["result"][0].alias("r"))
    rows = rows.select("series_id", F.posexplode(F.arrays_zip(F.col("r.timestamp").alias("t"), F.col("r.indicators.quote")[0]["close"].alias("close"))))
    return rows.select("series_id", F.timestamp_seconds("col.t").cast("date").alias("day"), F.struct(F.col("col.t").alias("ts"), "pos").alias("order"), F.col("col.close").alias("price"))


def as_payloads(closes: DataFrame) -> DataFrame:
    """series_id, payload of closes(series_id, ts, close): a payload holds one series of daily closes, some hundreds a year."""
    rows = closes.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("ts", "close"))).alias("c"))
    quote = F.array(F.struct(F.col("c.close").alias("close")))
    result = F.array(F.struct(F.col("c.ts").alias("timestamp"), F.struct(quote.alias("quote")).alias("indicators")))
    return rows.select("series_id", F.to_json(F.struct(F.struct(result.alias("result")).alias("chart")), {"ignoreNullFields": "false"}).alias("payload"))


def line_digests(prices: DataFrame) -> DataFrame:
    """series_id, n, sha256: the published fingerprint of a series of daily closes, over lines 'seconds,close' in order.

    It is one hash over all lines, so a series meets in one row, as in its payload; `digests` is for series of any length."""
    line = F.concat_ws(",", F.col("order.ts").cast("string"), F.format_string("%.6f", "price"))
    rows = prices.where("price IS NOT NULL").groupBy("series_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("order", line.alias("line")))).alias("c"))
    return rows.select("series_id", "n", F.sha2(F.array_join("c.line", "\n"), 256).alias("sha256"))


def stepped(prices: DataFrame) -> DataFrame:
    """Adds value (ln price), opens (first row of its day), step (value less that of the row before, within the day) and steps
    (how many of the day's steps are defined up to here); null prices are left out first."""
    rows = prices.where("price IS NOT NULL AND NOT isnan(price)").withColumn("value", F.when((F.col("price") > 0) & (F.col("price") < float("inf")), F.ln("price")))
    ordered = Window.partitionBy("series_id", "day").orderBy("order")
    rows = rows.withColumn("opens", F.row_number().over(ordered) == 1).withColumn("step", F.col("value") - F.lag("value").over(ordered))
    return rows.withColumn("steps", F.count("step").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))


def carried(rows: DataFrame) -> DataFrame:
    """One row for each series and day of stepped rows: what the day takes over from the days before, and the series' n and spread."""
    step, square = F.col("step"), F.col("step") * F.col("step")
    days = rows.groupBy("series_id", "day").agg(
        F.max_by("value", "order").alias("last"), F.max(F.when(F.col("opens"), F.col("value"))).alias("opening"), F.count(step).alias("inner"),
        F.sum(step).alias("total"), F.sum(square).alias("squares"), F.min(step).alias("least"), F.max(step).alias("most"),
    )
    by_day, whole = Window.partitionBy("series_id").orderBy("day"), Window.partitionBy("series_id")
    days = days.withColumn("before", F.lag("last").over(by_day)).withColumn("gap", F.col("opening") - F.col("before"))
    size, zero = F.col("inner") + F.when(F.col("gap").isNotNull(), 1).otherwise(0), F.lit(0.0)
    days = days.withColumn("offset", F.coalesce(F.sum(size).over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum(size).over(whole))
    mean = F.sum(F.coalesce("total", zero) + F.coalesce("gap", zero)).over(whole) / F.col("n")
    power = F.sum(F.coalesce("squares", zero) + F.coalesce(F.col("gap") * F.col("gap"), zero)).over(whole) / F.col("n")
    flat = F.min(F.least("least", "gap")).over(whole) == F.max(F.greatest("most", "gap")).over(whole)
    spread = F.when(flat, 0.0).otherwise(F.sqrt(F.greatest(power - mean * mean, zero)))
    return days.where("n > 0").select("series_id", "day", "before", "gap", "offset", "n", spread.alias("spread"))


def measured(prices: DataFrame, standardised: bool = True) -> DataFrame:
    """series_id, i, r, n: the returns of every series, with how many there are. Rows are ordered within days only."""
    rows = stepped(prices)
    rows = rows.join(carried(rows), ["series_id", "day"])
    rows = rows.withColumn("r", F.when(F.col("opens"), F.col("gap")).otherwise(F.col("step"))).where("r IS NOT NULL")
    place = F.col("offset") + F.col("steps") + F.when(F.col("gap").isNotNull(), 0).otherwise(-1)
    place = F.when(F.col("opens"), F.col("offset")).otherwise(place)
    r = F.try_divide("r", "spread") if standardised else F.col("r")
    return rows.select("series_id", place.alias("i"), r.alias("r"), "n")


def returns(prices: DataFrame, standardised: bool = True) -> DataFrame:
    """series_id, i, r of prices: log returns over the closes that exist, divided by their deviation within the series."""
    return measured(prices, standardised).drop("n")


def digests(prices: DataFrame) -> DataFrame:
    """series_id, n, sha256: a fingerprint of the whole cents of a series in order, taken by day and then over the days."""
    cents = F.bround(F.col("price") * 100).cast("long").cast("string")
    rows = prices.where("price IS NOT NULL").groupBy("series_id", "day").agg(F.array_sort(F.collect_list(F.struct("order", cents.alias("cents")))).alias("c"), F.count("*").alias("rows"))
    rows = rows.select("series_id", "day", "rows", F.sha2(F.array_join(F.transform("c", lambda x: x["cents"]), "\n"), 256).alias("part"))
    whole = rows.groupBy("series_id").agg(F.sum("rows").alias("n"), F.array_sort(F.collect_list(F.struct("day", "part"))).alias("parts"))
    return whole.select("series_id", "n", F.sha2(F.array_join(F.transform("parts", lambda x: x["part"]), "\n"), 256).alias("sha256"))


def verified(found: DataFrame, expected: DataFrame) -> DataFrame:
    """found digests with a boolean ok: the fingerprint and the number of rows are as expected(series_id, n, sha256)."""
    want = expected.select("series_id", F.col("n").alias("want_n"), F.col("sha256").alias("want"))
    return found.join(want, "series_id", "left").withColumn("ok", F.coalesce((F.col("n") == F.col("want_n")) & (F.col("sha256") == F.col("want")), F.lit(False))).drop("want", "want_n")


SETS = {"li6": li6, "li3": li3, "ord5": ord5, "reg5": reg5, "ev5": ev5}
