"""The operators over the driver's tables, as queries, and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.llm import chat_format, decontamination, edit_prints, language_id, line_dedup, mixing, near_dedup, nearest, spelling, suffix_dedup, toxicity, url_filter, vector_codes

TOKENIZER = os.environ.get("PUBLIC_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
TOXIC_FROM = 0.7
EPOCH = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.held_out()
    model = language_id.fit(docs.where(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_id.held_out(parts=3, part=1)
    model = toxicity.fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "spans")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), digest=True)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_conversations(rows.unionByName(extra), TOKENIZER)).drop("n_tokens", "loss_tokens")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures of a day that follows from page_id, against a list in which hosts come, go and get exceptions."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = lambda n: F.date_add(F.lit(EPOCH).cast("date"), n.cast("int"))
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", day(F.col("page_id") * 37 % 400).cast("timestamp").alias("fetched_at"))
    hosts = pages.select(F.regexp_extract(F.lower("url"), url_filter.HOST, 1).alias("host")).where("host <> ''").distinct()
    number = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long")
    listed = F.explode(
        F.array(
            F.struct(F.col("host").alias("pattern"), F.lit("block").alias("action"), (number % 150).alias("n")),
            F.struct(F.col("host").alias("pattern"), F.lit("remove").alias("action"), (150 + number % 120).alias("n")),
            F.struct(F.concat("host", F.lit("/en")).alias("pattern"), F.lit("allow").alias("action"), (number % 200).alias("n")),
            F.struct(F.regexp_replace("host", r"^[^.]*\.", "").alias("pattern"), F.lit("review").alias("action"), (200 + number % 100).alias("n")),
        )
    ).alias("e")
    entries = hosts.select(listed).select("e.pattern", "e.action", day(F.col("e.n")).alias("added_on"))
    judged = url_filter.judge_captures(captures, entries)
    return judged.select("capture_id", "url", F.col("fetched_at").cast("date").alias("fetched_on"), "pattern", "action", F.col("since").cast("date").alias("since"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = vector_codes.fit(vectors)
    coded = vector_codes.by_label(vector_codes.encode(vectors, books))
    digest = F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256")
    return coded.select("vec_id", vector_codes.hex_codes().alias("code"), "error", "label_error", digest)


def op12_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_prints.edit_fingerprints(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(table(spark, sf_dir, "documents"), one_in=spelling.DAMAGE))


def queries() -> dict:
    named = [op1_suffix_dedup, op2_language_id, op3_near_dedup, op4_toxicity, op5_decontamination, op6_nearest, op7_mixing, op8_line_dedup, op9_chat_format, op10_url_filter, op11_vector_codes, op12_edit_fingerprints, op13_spelling_variants]
    return {f.__name__: f for f in named}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT r, doc_id, i, parts[i] AS line,
         translate(regexp_replace(parts[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT r, doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM docs)),
hot AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(h.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE h.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN hot h USING (key) GROUP BY r"""

SHINGLE_SQL = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
ids AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS d FROM shingles GROUP BY doc_id),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY d) AS node FROM ids),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  WHERE a.doc_id IN (SELECT node FROM classes) AND b.doc_id IN (SELECT node FROM classes) GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT node, node AS other FROM (SELECT DISTINCT node FROM classes) UNION SELECT reach.node, ways.b FROM reach JOIN ways ON ways.a = reach.other),
comps AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT docs.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, docs.doc_id) AS component_id, coalesce(component, docs.doc_id) = docs.doc_id AS kept
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN classes USING (doc_id) LEFT JOIN comps ON comps.node = classes.node"""

CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(replace(replace(role, chr(26), chr(26) || 'e'), '<|', '<' || chr(26) || '|'))
          + length(replace(replace(text, chr(26), chr(26) || 'e'), '<|', '<' || chr(26) || '|')) + 23 AS size FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""

URL_SQL = r"""
WITH captures AS (
  SELECT page_id AS capture_id, url, DATE '2024-01-01' + (page_id * 37 % 400)::INT AS fetched_on,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#@]+?)\.?(?:[:/?#]|$)', 1) AS host,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS part FROM pages),
hosts AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 6))::BIGINT AS n FROM captures WHERE host <> ''),
entries AS (
  SELECT host AS pattern, 'block' AS action, n % 150 AS day FROM hosts UNION ALL SELECT host, 'remove', 150 + n % 120 FROM hosts
  UNION ALL SELECT host || '/en', 'allow', n % 200 FROM hosts UNION ALL SELECT regexp_replace(host, '^[^.]*\.', ''), 'review', 200 + n % 100 FROM hosts),
days AS (SELECT pattern, DATE '2024-01-01' + day::INT AS since, max(action) AS action FROM entries GROUP BY pattern, day),
valid AS (SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM days),
labels AS (SELECT *, string_split(host, '.') AS l FROM captures),
parents AS (SELECT *, unnest([array_to_string(l[i:], '.') FOR i IN range(1, len(l) + 1)]) AS h FROM labels WHERE host <> '' AND length(host) <= 253),
tried AS (SELECT capture_id, fetched_on, h AS pattern FROM parents UNION ALL SELECT capture_id, fetched_on, h || '/' || part FROM parents WHERE part <> ''),
met AS (
  SELECT capture_id, v.pattern, v.action, v.since, row_number() OVER (PARTITION BY capture_id ORDER BY length(v.pattern) DESC, v.pattern DESC) AS place
  FROM tried t JOIN valid v ON v.pattern = t.pattern AND t.fetched_on >= v.since AND (v.until IS NULL OR t.fetched_on < v.until) AND v.action <> 'remove')
SELECT c.capture_id, c.url, c.fetched_on, m.pattern, m.action, m.since FROM captures c LEFT JOIN met m ON m.capture_id = c.capture_id AND m.place = 1"""


def code_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS, scale: int = vector_codes.SCALE) -> str:
    """Every round as two tables: the nearest entry of every part, and the entries moved."""

    def nearest(k: int) -> str:
        far = "list_sum(list_transform(list_zip(parts.x, book.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"near{k} AS MATERIALIZED (SELECT row, p, arg_min(e, (far, e)) AS e, min(far) AS far FROM (SELECT row, p, e, {far}::BIGINT AS far FROM parts JOIN book{k} book USING (p)) GROUP BY row, p)"

    def moved(k: int) -> str:
        floor = "((total - ((total % n) + n) % n) // n)::BIGINT"
        sums = f"SELECT p, e, i, sum(x[i])::BIGINT AS total, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM parts JOIN near{k} USING (row, p)) GROUP BY p, e, i"
        return f"book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (SELECT p, e, list({floor} ORDER BY i) AS x FROM ({sums}) GROUP BY p, e) m USING (p, e))"

    steps = ",\n".join(f"{nearest(k)},\n{moved(k)}" for k in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, p, q[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})] AS x FROM (SELECT row, q, unnest(range({parts})) AS p FROM kept)),
book0 AS MATERIALIZED (SELECT p, row - 1 AS e, x FROM parts WHERE row <= {entries}),
{steps},
{nearest(rounds)},
coded AS MATERIALIZED (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM near{rounds} GROUP BY row),
digest AS (SELECT sha256(string_agg(c, ',' ORDER BY p, e)) AS d FROM (SELECT p, e, array_to_string(x, ',') AS c FROM book{rounds}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, d AS codebooks_sha256 FROM kept JOIN coded USING (row), digest"""


# the checksum's table comes from its polynomial, bit by bit; near words share what a deletion leaves
SPELLING_SQL = rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tbl),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS w FROM documents),
own AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS seed, w, count(*) AS n FROM runs WHERE length(w) >= {spelling.LEAST_CHARS} GROUP BY doc_id, w),
bytes AS (SELECT w, n, list_transform(range(1, strlen(seed) + 1), lambda k: ('0x' || substr(hex(encode(seed)), (2 * k - 1)::BIGINT, 2))::BIGINT) AS b FROM own),
sums AS MATERIALIZED (SELECT w, n, xor(4294967295, list_reduce(list_concat([4294967295], b), lambda c, x: xor(tbl[(xor(c, x) & 255) + 1], c >> 8))) AS h FROM bytes, crc),
hurt AS (SELECT CASE WHEN h % {spelling.DAMAGE} = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w) + 2)::BIGINT) ELSE w END AS word, n FROM sums),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM hurt WHERE length(word) >= {spelling.LEAST_CHARS} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
cuts AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.rest UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.rest),
best AS (SELECT p.word, p.other, o.n AS other_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, p.other) AS place FROM pairs p JOIN words o ON o.word = p.other),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {spelling.FACTOR} * w.n THEN other END AS form, CASE WHEN other_n >= {spelling.FACTOR} * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1),
up AS (SELECT word, word AS root, 0 AS far FROM formed UNION ALL SELECT up.word, f.form, far + 1 FROM up JOIN formed f ON f.word = up.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, far) AS root FROM up GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""


def oracle_sql() -> dict[str, str]:
    return {"op13_spelling_variants": SPELLING_SQL, "op11_vector_codes": code_sql(), "op3_near_dedup": SHINGLE_SQL, "op8_line_dedup": LINE_SQL, "op9_chat_format": CHAT_SQL, "op10_url_filter": URL_SQL}
