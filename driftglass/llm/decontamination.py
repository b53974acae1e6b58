"""Benchmark decontamination by templates. DataFrame functions only.

Texts become templates: numbers, units after numbers, and names (capitalised words inside a sentence) turn into typed
placeholders, all else into lower-case words. Windows of `width` template words meet the benchmark's windows in a hash
join, which finds a question again after its numbers or names were replaced. For items with placeholders, the values in a
document are then held against the item's: along one alignment of document and item, each value of the item must
always stand for the same value of the document. Alignments that break this don't count.

A window has up to three templates: `inner` as above, `folded` (words in lower case, only numbers and units replaced; a
window with fewer than half its words outside placeholders keeps its values) and `capital` (all capitalised words are
names, at a sentence's start too). So no window of an item is without a template. `inner` and `capital` are used where half
the words or more are outside placeholders. Slots are numbers, units, names inside sentences, and other capitalised words
that the benchmark never writes in lower case (names at a sentence's start). A conflict in `inner` or `capital` counts for all
templates of its alignment, one in `folded` for itself.

A document is contaminated by an item if it has at least min_windows of the item's windows (or all, if there are fewer)
in alignments without conflicts, or as many of those that have the template `inner`. Items of SHORTEST words or more but
fewer than `width` are one window. Shorter items would stand in many clean texts by chance: they are found where they are a
whole line of a document, or all of it, up to case and punctuation (matched and n_windows are 1 then).

Long texts (over 200,000 characters) are cut behind the ends of sentences into pieces of about PIECE characters, with some words of the next one, so that
a row never holds the windows of a whole long text; an alignment is one within a piece.

Scale: windows are hashed where the text is read, all widths in one pass. Words are hashed once for each template; windows are
slices of these hashes, taken where their places are exploded, in compiled code: lambda functions are interpreted, word by word. The benchmark's windows are broadcast only up to
BROADCAST_WINDOWS (counted first); beyond that, hashes are shuffled for the join. Per document and item only counts are shuffled.

Cases: null and empty texts match nothing; rows that share a doc_id are judged together; items with equal text each get
their rows; items without a letter or digit are never found; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftglass.llm.storage import broadcast_if_small, stored

# Units of measure, as written after numbers.
UNITS = "mm|cm|m|km|mg|g|kg|ml|l|s|sec|min|h|hr|hrs|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|ft|inches|in|lbs?|oz|mph|kph|km/h|%|percent|dollars?|cents?|euros?|usd|eur|°[CF]?"
NUMBER = r"[-+]?[$€£]?\d+(?:[.,:/]\d+)*"
INNER = r"(?=\p{Lu}[\p{L}\p{M}]*\p{Ll})(?<=[\p{Ll},;] )"  # the test that fails at most places comes first
MARK, UNIT, NAMED = "\u0001", "\u0002", "\u0003"
SHORTEST = 5
PIECE, OVERLAP = 100_000, 4096  # characters
BROADCAST_WINDOWS = 500_000


def pieces(text: Column, end: str, overlap: int) -> Column:
    """A long text cut behind the first match of `end` after every PIECE characters (a short text: itself), and each piece
    followed by the whole words among the next `overlap` characters."""
    cut = F.when(F.length(text) <= 2 * PIECE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{{PIECE}}}.*?{end}|.+"), 0))
    if not overlap:
        return cut
    more = lambda all_, k: F.regexp_replace(F.substring(F.coalesce(F.get(all_, k + 1), F.lit("")), 1, overlap), r"\S*$", "")
    return let(cut, lambda all_: F.when(F.size(all_) == 1, all_).otherwise(F.transform(all_, lambda x, k: F.concat(x, more(all_, k)))))


def raw_words(text: Column) -> Column:
    """The words of a text: numbers after MARK, units after UNIT, names inside sentences after NAMED, others as they stand."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{MARK}{UNIT}{NAMED}]", " ")
    text = F.regexp_replace(text, INNER, NAMED)
    text = F.regexp_replace(text, rf"(?=[-+$€£\d])(?<![\p{{L}}\p{{M}}\d])({NUMBER})(?:\s?({UNITS}))?(?![\p{{L}}\p{{M}}\d])", f" {MARK}$1 {UNIT}$2 ")
    text = F.regexp_replace(text, rf"(?=[^a-z])(?:([{MARK}{UNIT}][^ ]*)|[^\p{{L}}\p{{M}}\p{{N}}{MARK}{UNIT}{NAMED}]+)", "$1 ")  # values stay whole
    return F.filter(F.split(text, " "), lambda w: (w != "") & (w != UNIT))


def value(w: Column) -> Column:
    """What stands at a raw word's place."""
    return F.lower(F.when(w.startswith(NAMED), F.substring(w, 2, 1 << 30)).otherwise(w))


def placeholder(w: Column) -> Column:
    return w < NAMED  # begins with MARK or UNIT


def folded(w: Column) -> Column:
    marked = F.when(w.startswith(MARK), MARK + "n").when(w.startswith(UNIT), MARK + "u").otherwise(value(w))
    return F.when(w >= "\u0004", F.lower(w)).otherwise(marked)  # most words; spares the rest


def capitalised(w: Column) -> Column:
    """Whether a raw word is a name of the template `capital`: it has a capital first and is not all in capitals."""
    plain = (w >= "a") & (w < "{")  # most words; spares the rest
    return ~plain & (w.startswith(NAMED) | (~placeholder(w) & (F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1))) & (w != F.upper(w))))


def template_words(raw: Column) -> Column:
    """Raw words as structs: the word of each template, and v, what stands there."""
    name = F.lit(MARK + "p")
    return F.transform(
        raw,
        lambda w: F.struct(
            folded(w).alias("folded"),
            F.when(w.startswith(NAMED), name).otherwise(folded(w)).alias("inner"),
            F.when(capitalised(w), name).otherwise(folded(w)).alias("capital"),
            value(w).alias("v"),
        ),
    )


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), for a value that f uses more than once: it is made once, however Spark merges projections."""
    return F.transform(F.array(value), f)[0]


def word_hashes(raw: Column, least: Column) -> Column:
    """Hashes of raw words by template: folded, inner, capital. Where placeholders of numbers and units can be more than half
    of a window of `least` words or more (few texts have so many), also valued, of what stands there, and marks, 1 for a placeholder."""
    name = F.xxhash64(F.lit(MARK + "p"))
    of_inner = lambda words, h: F.zip_with(words, h, lambda w, x: F.when(w.startswith(NAMED), name).otherwise(x))
    of_capital = lambda words, h: F.zip_with(words, h, lambda w, x: F.when(capitalised(w), name).otherwise(x))
    of_values = lambda words, h: F.zip_with(words, h, lambda w, x: F.when(placeholder(w), F.xxhash64(value(w))).otherwise(x))
    marks = lambda words: F.transform(words, lambda w: F.when(placeholder(w), 1).otherwise(0))

    def made(words: Column, h: Column) -> Column:
        dense = 2 * F.array_size(F.filter(words, placeholder)) > least
        valued = F.when(dense, F.struct(of_values(words, h).alias("hashes"), marks(words).alias("marks")))
        return F.struct(h.alias("folded"), of_inner(words, h).alias("inner"), of_capital(words, h).alias("capital"), valued.alias("valued"))

    return let(raw, lambda words: let(F.transform(words, lambda w: F.xxhash64(folded(w))), lambda h: made(words, h)))


def windows(rows: DataFrame, raw: Column, widths: Column) -> DataFrame:
    """rows, for each window of these widths (an array, ascending) of their raw words: with width, at, and its hash in each template."""
    keys = rows.columns
    rows = rows.select("*", word_hashes(raw, widths[0]).alias("_words")).select(*keys, "_words.*")
    rows = rows.select("*", F.explode(widths).alias("width"))
    last = F.array_size("folded") - F.col("width")
    rows = rows.select("*", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("at"))
    hashed = lambda words: F.xxhash64(F.slice(words, F.col("at") + 1, F.col("width")))
    # a window with fewer than half its words outside placeholders keeps its values
    n_values = F.array_size(F.array_remove(F.slice("valued.marks", F.col("at") + 1, F.col("width")), 0))
    best = F.when(F.col("valued").isNotNull() & (2 * n_values > F.col("width")), hashed("valued.hashes")).otherwise(hashed("folded"))
    return rows.select(*keys, "width", "at", best.alias("folded"), hashed("inner").alias("inner"), hashed("capital").alias("capital"))


def literal(words: Column, template: str) -> Column:
    return F.array_size(F.filter(words, lambda w: ~w[template].startswith(MARK)))


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """item_id, width, item_at, hash, templates, used (it has the template `inner`), n_windows, n_used of items(item_id, raw, words)."""
    items = items.withColumn("own", F.least(F.lit(width), F.array_size("raw"))).where(F.col("own") >= SHORTEST)
    rows = windows(items.select("item_id", "own", "words", "raw"), F.col("raw"), F.array("own"))
    rows = rows.withColumn("window", F.slice("words", F.col("at") + 1, F.col("own"))).drop("words")
    enough = lambda template: 2 * literal(F.col("window"), template) >= F.col("own")
    made = F.array(
        F.struct(F.lit("folded").alias("template"), F.col("folded").alias("hash")),
        F.struct(F.when(enough("inner"), F.lit("inner")).alias("template"), F.col("inner").alias("hash")),
        F.struct(F.when(enough("capital"), F.lit("capital")).alias("template"), F.col("capital").alias("hash")),
    )
    rows = rows.select("item_id", "width", F.col("at").alias("item_at"), enough("inner").alias("used"), F.explode(made).alias("m")).where("m.template IS NOT NULL")
    rows = rows.groupBy("item_id", "width", "item_at", "used", F.col("m.hash").alias("hash")).agg(F.sort_array(F.collect_set("m.template")).alias("templates"))
    sizes = rows.groupBy("item_id").agg(F.count_distinct("item_at").alias("n_windows"), F.count_distinct(F.when(F.col("used"), F.col("item_at"))).alias("n_used"))
    return rows.join(sizes, "item_id")


def item_slots(items: DataFrame) -> DataFrame:
    """item_id and slots (for each word: what stands there if it is a slot, else null) of the items that have one."""
    words = items.select("item_id", F.posexplode("words").alias("at", "w"))
    names = words.where(F.col("w.capital").startswith(MARK) & ~F.col("w.folded").startswith(MARK)).select(F.col("w.v").alias("v"))
    lower = words.where(F.col("w.capital") == F.col("w.v")).select(F.col("w.v").alias("v"))
    names = names.distinct().join(lower.distinct(), "v", "left_anti").withColumn("name", F.lit(True))
    words = words.withColumn("v", F.col("w.v")).join(names, "v", "left")
    slot = F.when(F.col("w.inner").startswith(MARK) | (F.col("w.capital").startswith(MARK) & F.col("name")), F.col("v"))
    # one array for each item, as long as its text
    found = words.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("at", slot.alias("slot")))).alias("slots"))
    return found.select("item_id", F.col("slots.slot").alias("slots")).where(F.exists("slots", lambda s: s.isNotNull()))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "))


def short_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of documents in which an item of items(item_id, text) is a whole line, or the whole text."""
    items = stored(items.select("item_id", normal(F.col("text")).alias("line")).where("line <> ''"), "short-items")
    n = items.agg(F.count("*").alias("n"), F.max(F.length("line")).alias("longest")).first()
    if not n.n:
        return docs.select("doc_id").join(items, F.lit(False)).select("doc_id", "item_id")
    fits = lambda lines: F.filter(F.array_distinct(F.transform(lines, normal)), lambda x: F.length(x) <= n.longest)
    parts = docs.select("doc_id", F.explode(pieces(F.col("text"), "\n", 0)).alias("text"))
    lines = parts.select("doc_id", F.explode(fits(F.split("text", "\n"))).alias("line"))
    lines = lines.unionByName(docs.select("doc_id", F.explode(fits(F.array("text"))).alias("line")))
    return lines.join(F.broadcast(items) if n.n <= BROADCAST_WINDOWS else items, "line").select("doc_id", "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, min_windows: int = 4) -> DataFrame:
    """doc_id, item_id, matched, n_windows, slots_compared for every document of docs(doc_id, text) that holds an item."""
    docs = docs.select("doc_id", "text")
    items = benchmark.select("item_id", "text", raw_words(F.col("text")).alias("raw"))
    items = stored(items.withColumn("words", template_words(F.col("raw"))), "items")
    short = short_hits(docs, items.where(F.array_size("raw") < min(SHORTEST, width)))
    short = short.select("doc_id", "item_id", F.lit(1).cast("long").alias("matched"), F.lit(1).cast("long").alias("n_windows"), F.lit(0).cast("long").alias("slots_compared"))
    items = items.drop("text")
    known = stored(item_windows(items, width), "item-windows")
    about = known.agg(F.count("*").alias("n"), F.collect_set("width").alias("widths")).first()  # widths: SHORTEST to width
    if not about.n:
        return short
    small = F.broadcast(known) if about.n <= BROADCAST_WINDOWS else known
    docs = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(pieces(F.col("text"), r"[.!?]\s", OVERLAP)).alias("piece", "text"))
    widths = F.array(*(F.lit(w) for w in sorted(about.widths)))
    found = windows(docs, raw_words(F.col("text")), widths)
    one = (F.col("folded") == F.col("inner")) & (F.col("folded") == F.col("capital"))
    hash_ = F.when(one, F.array("folded")).otherwise(F.array("folded", "inner", "capital"))
    found = found.select("doc_id", "piece", F.col("at").alias("doc_at"), F.explode(hash_).alias("hash"))
    hits = found.join(small, "hash")  # one long as key; windows of other widths have other hashes
    hits = hits.select("doc_id", "piece", "item_id", "n_windows", "n_used", "used", "templates", "width", "item_at", (F.col("doc_at") - F.col("item_at")).alias("shift"))
    # copies of an item in one document, and rows with one doc_id, repeat windows: each is kept once for each alignment
    hits = stored(hits.distinct(), "hits")
    pair = ["doc_id", "item_id"]
    least = lambda n: F.least(F.lit(min_windows).cast("long"), F.col(n))
    enough = (F.col("matched") >= least("n_windows")) | ((F.col("n_used") > 0) & (F.col("matched_used") >= least("n_used")))
    matched = [F.count_distinct("item_at").alias("matched"), F.count_distinct(F.when(F.col("used"), F.col("item_at"))).alias("matched_used")]
    likely = hits.groupBy(*pair, "n_windows", "n_used").agg(*matched).where(enough)
    likely = stored(likely, "likely")

    # items with slots: compare what they stand for
    valued = stored(item_slots(items), "item-slots")
    doubtful = likely.join(valued, "item_id", "left_semi").select(*pair)
    wanted = doubtful.select("doc_id").distinct().withColumnRenamed("doc_id", "wanted_id")
    doc_words = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    doc_words = doc_words.select(F.col("doc_id").alias("words_id"), F.col("piece").alias("words_piece"), F.transform(raw_words(F.col("text")), value).alias("doc_words"))
    aligned = hits.join(doubtful.withColumnsRenamed({"doc_id": "d", "item_id": "i"}), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("item_id").eqNullSafe(F.col("i")), "left_semi")
    aligned = aligned.join(valued, "item_id").join(doc_words, F.col("doc_id").eqNullSafe(F.col("words_id")) & (F.col("piece") == F.col("words_piece")))
    slot = F.arrays_zip(F.slice("slots", F.col("item_at") + 1, F.col("width")).alias("item"), F.slice("doc_words", F.col("item_at") + F.col("shift") + 1, F.col("width")).alias("doc"))
    both = aligned.where(F.col("item_at") + F.col("shift") >= 0).select(*pair, "piece", "shift", "templates", F.explode(slot).alias("slot")).where("slot.item IS NOT NULL AND slot.doc IS NOT NULL")
    both = both.select(*pair, "piece", "shift", "slot", F.explode("templates").alias("template"))
    values = both.groupBy(*pair, "piece", "shift", "template", F.col("slot.item").alias("item")).agg(F.count_distinct("slot.doc").alias("meanings"))
    broken = F.collect_set(F.when(F.col("meanings") > 1, F.col("template")))
    values = values.groupBy(*pair, "piece", "shift").agg(F.count_distinct("item").alias("compared"), broken.alias("broken"))
    values = values.withColumnsRenamed({"doc_id": "d", "item_id": "i", "piece": "p", "shift": "s"})
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("item_id").eqNullSafe(F.col("i")) & (F.col("piece") == F.col("p")) & (F.col("shift") == F.col("s"))
    whole = ~F.arrays_overlap("broken", F.array(F.lit("inner"), F.lit("capital")))
    holds = F.col("broken").isNull() | (whole & (F.array_size(F.array_except("templates", "broken")) > 0))
    good = hits.join(values, same, "left").where(holds)
    out = good.groupBy(*pair, "n_windows", "n_used").agg(*matched, F.coalesce(F.max("compared"), F.lit(0)).cast("long").alias("slots_compared"))
    return out.where(enough).select(*pair, "matched", "n_windows", "slots_compared").unionByName(short)


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, min_windows: int = 4) -> DataFrame:
    """The rows of docs that hold no item of the benchmark."""
    found = stored(contaminated(docs, benchmark, width, min_windows).select(F.col("doc_id").alias("found_id")).distinct(), "found")
    return docs.join(broadcast_if_small(found), F.col("doc_id").eqNullSafe(F.col("found_id")), "left_anti")
