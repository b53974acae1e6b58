"""URL lists with history: every capture is judged by the entries that were active when it was fetched.

Dated entries (pattern, action, added_on) become validity intervals: an entry holds from its day until the next day on
which the same pattern is listed again (action 'remove' ends a listing and starts none). Captures are joined as of their
fetch time: a capture offers a few patterns (its host, all parent domains, and each of these with the first part of the
path), and of the active entries among them the longest pattern decides.

Patterns: 'host' or 'host/part', in lower case, without scheme and port. A host also matches its subdomains. A capture's host is
what follows the last @ before the path, without a port and without a dot at its end.

Scale: intervals are cut at those periods of `period_days` in which there are captures, so the as-of join is an equi-join on
pattern and period with the exact bounds checked inside it; a capture of a far day adds one period, not all up to it. A host
with a third of all captures spreads over its periods, and Spark can split what is still too large. A host name has at most
HOST_CHARS characters, so a capture offers at most HOST_CHARS + 1 patterns (as a rule four to eight); equal captures are
judged once. The periods are one array of numbers: at most 122,000 for the years 1 to 9999.

Cases: a null or malformed URL (one with a longer host is malformed too) or a null time matches nothing and gets action null;
of entries for one pattern and time, the greatest action counts; entries with a null pattern, day or action are ignored;
repeated captures stay repeated; empty tables give no rows, or null actions; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#@]+?)\.?(?:[:/?#]|$)"  # after the last @, without the dot of the root
PART = r"^[a-z][a-z0-9+.-]*://[^/?#]+/([^/?#]+)"
HOST_CHARS = 253  # fixed value: the greatest length of a host name


def validity(entries: DataFrame) -> DataFrame:
    """pattern, action, valid_from, valid_to (exclusive, null: open) of entries(pattern, action, added_on)."""
    known = entries.select(F.lower(F.trim("pattern")).alias("pattern"), "action", F.col("added_on").cast("timestamp").alias("valid_from"))
    known = known.where("pattern IS NOT NULL AND action IS NOT NULL AND valid_from IS NOT NULL").groupBy("pattern", "valid_from").agg(F.max("action").alias("action"))
    until = F.lead("valid_from").over(Window.partitionBy("pattern").orderBy("valid_from"))
    return known.withColumn("valid_to", until).where("action <> 'remove'")


def patterns(url: str) -> Column:
    """The patterns that a URL can match: its host and all parent domains, each alone and with a path part."""
    low = F.lower(F.col(url))
    host = F.regexp_extract(low, HOST, 1)
    labels = F.split(host, r"\.")
    n = F.array_size(labels)
    hosts = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    part = F.regexp_extract(low, PART, 1)
    both = F.when(part == "", hosts).otherwise(F.concat(hosts, F.transform(hosts, lambda h: F.concat(h, F.lit("/"), part))))
    return F.when((host != "") & (F.length(host) <= HOST_CHARS), both)


def judge_captures(captures: DataFrame, entries: DataFrame, period_days: int = 30) -> DataFrame:
    """capture_id, url, fetched_at of captures, with the pattern that decides, its action, and since when it held."""
    period = lambda c: F.floor(F.unix_timestamp(c) / (86400 * period_days))
    rows = captures.select("capture_id", "url", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    rows = rows.groupBy("capture_id", "url", "fetched_at").agg(F.count("*").alias("copies"))
    offered = rows.select("url", "fetched_at").where("url IS NOT NULL AND fetched_at IS NOT NULL").distinct()
    fetched = captures.select(period(F.col("fetched_at").cast("timestamp")).alias("p")).where("p IS NOT NULL").distinct()
    fetched = fetched.agg(F.collect_list("p"))  # one array
    listed = validity(entries).withColumns({"first": period("valid_from"), "last": period("valid_to")}).withColumn("periods", fetched.scalar())
    held = F.filter("periods", lambda p: (p >= F.col("first")) & (F.col("last").isNull() | (p <= F.col("last"))))
    listed = listed.withColumn("period", F.explode(held)).drop("first", "last", "periods")

    tried = offered.withColumn("period", period("fetched_at")).withColumn("pattern", F.explode(patterns("url")))
    active = (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    met = tried.join(listed, ["pattern", "period"]).where(active)
    best = F.max(F.struct(F.length("pattern").alias("size"), "pattern", "action", "valid_from")).alias("best")
    met = met.groupBy(F.col("url").alias("u"), F.col("fetched_at").alias("t")).agg(best)
    out = rows.join(met, (F.col("url") == F.col("u")) & (F.col("fetched_at") == F.col("t")), "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("capture_id", "url", "fetched_at", F.col("best.pattern").alias("pattern"), F.col("best.action").alias("action"), F.col("best.valid_from").alias("since"))
