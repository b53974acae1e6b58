"""Text operators of the corpus audit, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The categories and their patterns, counted on lower-case text.
CATEGORIES = {
    "fat-tails": r"(excess kurtosis|kurtosis|leptokurt|fat[\s\-]?tail|heavy[\s\-]?tail|tail index|hill estimator|power[\s\-]?law tail|tail exponent)",
    "vol-clustering": r"(volatility clustering|clustering of volatility|clustered volatilit|volatility cluster)",
    "long-memory": r"(long[\s\-]?memory|long[\s\-]?range dependence|slowly decaying autocorrelat|hurst exponent)",
    "leverage": r"(leverage effect|return[\s\-]volatility (asymmetry|correlation)|asymmetric volatilit)",
    "gain-loss-asymmetry": r"(gain[/\s\-]?loss asymmetry)",
    "absence-of-autocorr": r"(absence of (linear |significant )?autocorrelat|lack of autocorrelat|no (significant )?autocorrelat|uncorrelated returns|linear unpredictability)",
    "aggregational-gaussianity": r"(aggregational (gaussianity|normality)|aggregate gaussianity)",
    "volume-volatility-corr": r"(volume[\s\-]volatility (correlation|relation)|trading volume and volatility)",
    "regime-switching": r"(regime[\s\-]switching|regime shift)",
}
MENTION = r"stylized fact|stylised fact"
SIMULATION = r"agent[\s\-]based (model|simulation)|artificial (stock )?market|market simulat|simulated market|multi[\s\-]agent simulat"
# What is cut from pages and from papers, and the share of a text behind which a heading counts.
SCRIPT, TAG, SPACE = r"(?is)<(script|style)[^>]*>.*?</\1>", r"<[^>]+>", r"(?U)\s+"
BIBLIOGRAPHY = ("\\begin{thebibliography}", "\\bibliography{", "\\printbibliography")
ENTRY = r"(?s)\\bibitem.*?(?=\\bibitem|$)"
HEADING, BEYOND = r"\b(?:References|REFERENCES|Bibliography)\b", 0.4
# End of fixed values.


def strip_html(html: Column) -> Column:
    """Scripts and styles go with their content, every other tag becomes a space, white space collapses."""
    text = F.regexp_replace(html, SCRIPT, "")
    return F.regexp_replace(F.regexp_replace(text, TAG, " "), SPACE, " ")


def before(text: Column, place: Column) -> Column:
    """What stands before a place counted from 1; all of it where the place is 0."""
    return F.when(place > 0, F.substring(text, F.lit(1), place - 1)).otherwise(text)


def strip_references(text: Column) -> Column:
    """Bibliographies are cut at their LaTeX markers, and at the last heading if it stands beyond 40 percent of the text."""
    for mark in BIBLIOGRAPHY:
        text = before(text, F.instr(text, mark))
    text = F.regexp_replace(text, ENTRY, " ")
    head = F.regexp_extract(text, f"(?s)^(.*){HEADING}", 1)
    found = F.regexp_like(text, F.lit(HEADING))
    return F.when(found & (F.length(head) > BEYOND * F.length(text)), head).otherwise(text)


def labels(listed: Column) -> Column:
    """Comma-separated labels, trimmed, in lower case, sorted; empty ones go."""
    parts = F.transform(F.split(F.coalesce(listed, F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.filter(parts, lambda x: x != ""))


def audit(docs: DataFrame, doc_id: str, text: str, categories: dict[str, str] | None = None, mention: str = MENTION, simulation: str = SIMULATION) -> DataFrame:
    """Per document: length of its body, inclusion flags, counts per category, and the categories found once and three times."""
    categories = categories or CATEGORIES
    rows = docs.select(doc_id, F.col(text).isNotNull().alias("fetched"), strip_references(F.coalesce(F.col(text), F.lit(""))).alias("body"))
    rows = rows.withColumn("low", F.lower("body"))
    counts = F.map_from_arrays(F.array(*map(F.lit, categories)), F.array(*(F.regexp_count("low", F.lit(p)) for p in categories.values())))
    at_least = lambda n: F.array_sort(F.map_keys(F.map_filter("counts", lambda _, v: v >= n)))
    rows = rows.select(doc_id, "fetched", F.length("body").cast("long").alias("nchar"), F.regexp_like("body", F.lit(f"(?i){mention}")).alias("sf_mention"), F.regexp_like("body", F.lit(f"(?i){simulation}")).alias("is_sim"), counts.alias("counts"))
    return rows.withColumn("ge1", at_least(1)).withColumn("ge3", at_least(3))


def prevalence(audited: DataFrame) -> DataFrame:
    """category, docs, share_ge1, share_ge3 among the documents that are included."""
    rows = audited.where("fetched AND sf_mention AND is_sim").select(F.explode("counts").alias("category", "n"))
    return rows.groupBy("category").agg(F.count("*").alias("docs"), F.avg((F.col("n") >= 1).cast("double")).alias("share_ge1"), F.avg((F.col("n") >= 3).cast("double")).alias("share_ge3"))
