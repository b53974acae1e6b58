"""Document fingerprints by a randomised edit embedding: texts a few edits apart have embeddings that differ in few places.

1. Embedding: a walk reads a text's characters one at a time; at step j it writes the current character, and a random bit of
   (j, character), shared by all texts, says whether it goes on to the next. Two walks that an edit has put out of step
   fall into step again by chance, so edit distance becomes Hamming distance. A text is walked in stretches of STRETCH
   characters, each with STEPS places of its own in the embedding, all stretches of a batch side by side.
2. Sampling: of the places from 2**o to 2**(o + 1), SAMPLES are kept (all, where there are fewer), whatever the text. A
   sample is the low bits of its character's hash, 1 to 15, or 0 where the walk has ended, and one digit of the fingerprint.
   So a fingerprint grows by SAMPLES digits when a text doubles, and equal texts have equal ones.
3. Likeness: the share of equal places among those that either walk reaches, each sample standing for the places of its
   octave. Unrelated texts come to about 0.1, as some characters agree by chance.
4. Banding: BANDS keys of DIGITS sampled digits each, from the last two octaves that a text reaches. Texts with a common key are compared
   on whole fingerprints (`linked`): with a leader of the key first, then, where a key still holds several components,
   block by block.

Scale: `with_next` gives every document its successor in descending doc_id without a global sort in one task: a first pass
over (doc_id, digest) finds ranges, a second deals the texts to them, once, and each range gets a copy of the next one's first text.
Everything after that is a stream through a range; a task holds one batch, and one text more.

Cases: a null text is an empty one, with an empty fingerprint; two empty ones are alike (1), an empty and another not (0).
doc_ids that repeat are in order of a digest of their texts, so reruns agree; equal rows are interchangeable; a null doc_id
comes last. A single document is its own successor. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftglass.llm.near_dedup import components
from driftglass.llm.storage import broadcast_if_small, small_batches, stored

STRETCH, STEPS, SAMPLES, OCTAVES = 1024, 2304, 128, 40
LANES, CHARS, RANGE_BYTES = 4096, 4 << 20, 32 << 20
BANDS, DIGITS, BLOCK = 32, 6, 1024
SEED = 20261
_rng = np.random.default_rng(SEED)
ADVANCE = _rng.integers(0, 2, (STEPS, 256), dtype=np.uint8)  # the random bits; 0, past the end, goes nowhere
ADVANCE[:, 0] = 0
DIGIT = np.append(0, _rng.integers(1, 16, 255)).astype(np.uint8)
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
VALUE = np.zeros(256, np.uint8)
VALUE[HEX] = np.arange(16)
BMP = (np.uint64(1) + (np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(255)).astype(np.uint8)


def octave(o: int) -> np.ndarray:
    """The places sampled from 2**o to 2**(o + 1), in order."""
    size, own = 1 << o, np.random.default_rng([SEED, o])
    if size <= SAMPLES:
        return size + np.arange(size)
    return size + np.sort(own.choice(np.unique(own.integers(0, size, 4 * SAMPLES)), SAMPLES, replace=False))


PLACES = np.concatenate([np.zeros(1, np.int64), *map(octave, range(OCTAVES))])  # one for each digit; place 0 is the first
ENDS = np.append(1, 1 + np.cumsum([min(1 << o, SAMPLES) for o in range(OCTAVES)]))  # digits before each octave
WEIGHTS = np.append(1.0, np.concatenate([np.full(min(1 << o, SAMPLES), max(1.0, (1 << o) / SAMPLES)) for o in range(OCTAVES)]))


def digits_below(count: int) -> int:
    """How many digits stand for the first `count` places."""
    return int(np.searchsorted(PLACES, count))


def classes(text: str) -> np.ndarray:
    """A number from 1 to 255 for each character."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(points) and points.max() >= 1 << 16:
        points = (points ^ points >> np.uint32(16)) & np.uint32(0xFFFF)
    return BMP[points]


def walked(texts: list[np.ndarray], firsts: list[int]) -> list[np.ndarray]:
    """Digits of texts given by classes, from stretch firsts[i] on of their whole texts; texts aren't empty."""
    sizes = np.array([len(t) for t in texts])
    many = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(texts)), many)
    order = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)  # of a stretch in what is given
    length = np.minimum(sizes[owner] - order * STRETCH, STRETCH)
    start = np.repeat(np.cumsum(sizes + many) - (sizes + many), many) + order * (STRETCH + 1)
    flat = np.zeros(int((sizes + many).sum()), np.uint8)  # a 0 after every stretch
    at = np.arange(int(sizes.sum()))
    flat[at + np.repeat(np.arange(len(owner)), length)] = np.concatenate(texts)
    # samples of a stretch: those of its places, by its number in the whole text
    whole = order + np.array(firsts)[owner]
    last = int((many + firsts).max())
    edges = np.searchsorted(PLACES, np.arange(last + 1) * STEPS)
    begin = np.array([edges[f] for f in firsts])
    out = [np.zeros(edges[f + m] - edges[f], np.uint8) for f, m in zip(firsts, many)]
    for lanes in np.array_split(np.argsort(-length, kind="stable"), -(-len(owner) // LANES)):
        track = steps_of(flat, start[lanes], int(length[lanes[0]]))
        for lane, k in enumerate(lanes):
            a, b = edges[whole[k]], edges[whole[k] + 1]
            if a < b:
                i = owner[k]
                j = PLACES[a:b] - whole[k] * STEPS
                inside = j < len(track)
                out[i][a - begin[i] : b - begin[i]][inside] = track[j[inside], lane]
    return [DIGIT[x] for x in out]


def steps_of(flat: np.ndarray, start: np.ndarray, longest: int) -> np.ndarray:
    """What the walks from start write: a row a step, a column a walk; walks come by falling length."""
    track = np.zeros((min(STEPS, 3 * longest + 64), len(start)), np.uint8)
    at, open_ = start.copy(), len(start)
    for j in range(len(track)):
        here = at[:open_]
        c = flat[here]
        track[j, :open_] = c
        here += ADVANCE[j][c]
        if j % 64 == 63:
            still = np.flatnonzero(flat[here])
            open_ = int(still[-1]) + 1 if len(still) else 0
            if not open_:
                return track[: j + 1]
    return track


def trimmed(digits: np.ndarray) -> np.ndarray:
    """Without the zeros at the end."""
    some = np.flatnonzero(digits)
    return digits[: some[-1] + 1] if len(some) else digits[:0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The weighed share of equal digits among those of which one isn't 0; 1 for two empty fingerprints."""
    if len(a) < len(b):
        a, b = b, a
    if not len(a):
        return 1.0
    w = WEIGHTS[: len(a)]
    b = np.pad(b, (0, len(a) - len(b)))
    some = (a > 0) | (b > 0)
    return float(w[some & (a == b)].sum() / w[some].sum())


def named(digits: np.ndarray) -> str:
    return HEX[digits].tobytes().decode()


def valued(fingerprint: str) -> np.ndarray:
    return VALUE[np.frombuffer(fingerprint.encode(), np.uint8)]


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """Digits of whole texts."""
    out = [np.zeros(0, np.uint8)] * len(texts)
    given = [i for i, t in enumerate(texts) if t]
    for i, d in zip(given, walked([classes(texts[i]) for i in given], [0] * len(given)) if given else []):
        out[i] = trimmed(d)
    return out


def edited(text: str, following: str) -> str:
    """The text with its last third taken by the beginning of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def of_edited(pairs: list[tuple[str, str, np.ndarray]]) -> list[np.ndarray]:
    """Digits of edited texts, of (text, edited text, digits of text): only the stretches that an edit reaches are walked."""
    out, given, firsts = [x[2] for x in pairs], [], []
    for i, (text, new, digits) in enumerate(pairs):
        if new != text:
            first = (len(text) - len(text) // 3) // STRETCH
            if len(new) > first * STRETCH:
                given.append(i)
                firsts.append(first)
            head = digits_below(first * STEPS)
            out[i] = np.pad(digits, (0, max(0, head - len(digits))))[:head]
    rest = walked([classes(pairs[i][1][f * STRETCH :]) for i, f in zip(given, firsts)], firsts) if given else []
    for i, digits in zip(given, rest):
        out[i] = np.concatenate([out[i], digits])
    return [trimmed(x) for x in out]


PRINTED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order, (doc_id, text, last), with the next range's first at the end (last): the fingerprint of each
    but that, of its edited text, and how like it is to that and to the next."""
    held: tuple[int, str, np.ndarray] | None = None
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        first = 0
        while first < len(batch):
            some, size = [], 0
            while first + len(some) < len(batch) and (not some or size < CHARS):
                some.append(texts[first + len(some)].as_py() or "")
                size += len(some[-1])
            rows = list(zip(ids[first : first + len(some)], some, fingerprints(some)))
            first += len(some)
            rows = [held, *rows] if held else rows
            held = rows[-1]
            if len(rows) > 1:
                yield compared(rows)


def compared(rows: list[tuple[int, str, np.ndarray]]) -> pa.RecordBatch:
    """Every row but the last, with the one after it."""
    new = [edited(a[1], b[1]) for a, b in zip(rows, rows[1:])]
    prints = of_edited([(a[1], t, a[2]) for a, t in zip(rows, new)])
    columns = [
        pa.array([r[0] for r in rows[:-1]], pa.int64()), pa.array([len(r[1]) for r in rows[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]), pa.array([named(r[2]) for r in rows[:-1]]), pa.array([named(p) for p in prints]),
        pa.array([likeness(a[2], p) for a, p in zip(rows, prints)]), pa.array([likeness(a[2], b[2]) for a, b in zip(rows, rows[1:])]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PRINTED.split(", ")])


def place_in(limits: list[tuple[int, int]], id_: Column, digest: Column) -> Column:
    """How many limits (sorted pairs) lie above (id_, digest): by halving, on two literal arrays."""
    if not limits:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(limits).bit_length()))]
    ids, digests = (F.lit([x[k] for x in limits]).cast("array<bigint>") for k in (0, 1))
    below = lambda k: (F.get(ids, k) < id_) | ((F.get(ids, k) == id_) & (F.get(digests, k) < digest))
    seek = lambda lo, step: F.when((lo + step <= len(limits)) & below(lo + step - 1), lo + step).otherwise(lo)
    return F.lit(len(limits)) - F.aggregate(F.lit(steps), F.lit(0), seek)


LOWEST = -(1 << 63)


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, text, last) of docs, dealt to ranges of falling doc_id, each sorted and followed by the next one's first row."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").withColumns({"id_": F.coalesce("doc_id", F.lit(LOWEST)), "digest": F.xxhash64("text", "doc_id")})
    if ranges is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES + 1)
    keys = rows.select("id_", "digest").repartitionByRange(ranges, "id_", "digest").groupBy(F.spark_partition_id().alias("range"))
    tops = [tuple(r.top) for r in keys.agg(F.max(F.struct("id_", "digest")).alias("top")).collect()]  # a row a range
    if not tops:
        return rows.select("doc_id", "text", F.lit(False).alias("last"))
    tops.sort(reverse=True)  # the first of each range
    own = rows.withColumn("range", place_in(sorted(tops)[:-1], F.col("id_"), F.col("digest")))
    following = [(k, *tops[(k + 1) % len(tops)]) for k in range(len(tops))]
    following = F.broadcast(spark.createDataFrame(following, "range int, id_ long, digest long"))  # a row a range
    first = rows.join(following, ["id_", "digest"]).groupBy("range", "id_", "digest").agg(F.max("text").alias("text"))
    both = own.select("doc_id", "text", "id_", "digest", F.col("range").cast("int").alias("range"), F.lit(False).alias("last"))
    both = both.unionByName(first.select(F.lit(None).cast("long").alias("doc_id"), "text", "id_", "digest", "range", F.lit(True).alias("last")))
    both = both.repartitionById(len(tops), F.col("range")).sortWithinPartitions("last", F.desc("id_"), F.desc("digest"))
    return both.select("doc_id", "text", "last")


def edit_fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """PRINTED, for every row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    return with_next(docs, ranges).mapInArrow(print_batches, PRINTED)


def text_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of docs(doc_id, text), without a shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                digits = fingerprints([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([named(d) for d in digits], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


@functools.cache
def picked(o: int) -> np.ndarray:
    """The digits of BANDS keys, from those before octave o by what they stand for."""
    w = WEIGHTS[: ENDS[o]]
    return np.random.default_rng([SEED, 7, o]).choice(len(w), (BANDS, DIGITS), p=w / w.sum())


def bands_of(fingerprint: str) -> list[int]:
    """Keys from the digits before the last octave that the fingerprint reaches, and before the one before it."""
    digits, out = valued(fingerprint), []
    reached = int(np.searchsorted(ENDS, len(digits)))  # octaves that hold digits
    for o in {max(0, reached - 1), max(0, reached - 2)} if len(digits) else ():
        for k, shown in enumerate(digits[picked(o)]):
            out.append(int.from_bytes(hashlib.blake2b(bytes([o, k]) + shown.tobytes(), digest_size=8).digest(), "little", signed=True))
    return out


def band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [bands_of(p) for p in batch.column("fingerprint").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(keys, pa.list_(pa.int64()))], names=["node", "keys"])


def verify(least: float):
    """Of (a, b, p, q) those whose fingerprints p and q are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [likeness(valued(p), valued(q)) >= least for p, q in zip(batch.column("p").to_pylist(), batch.column("q").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def compare_cell(least: float):
    """Links between components in a cell(node, component, fingerprint, side): a member of one side with one of the other."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        digits = [valued(p) for p in rows.fingerprint]
        width = max(map(len, digits))
        table = np.stack([np.pad(d, (0, width - len(d))) for d in digits])
        w, comp, node, side = WEIGHTS[:width], rows.component.to_numpy(), rows.node.to_numpy(), rows.side.to_numpy()
        alone = (side == 0).all()
        right = np.flatnonzero(side == (0 if alone else 1))
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                x = up
            return x

        out = []
        for i in np.flatnonzero(side == 0):
            others = right[(comp[right] != comp[i]) & ((right > i) | (not alone))]
            some = (table[others] > 0) | (table[i] > 0)
            near = ((some & (table[others] == table[i])) @ w) / np.maximum(some @ w, 1e-9)
            for j in others[near >= least]:
                a, b = root(int(comp[i])), root(int(comp[j]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((int(node[i]), int(node[j])))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def linked(prints: DataFrame, least: float = 0.75, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id of prints(doc_id, fingerprint): the least doc_id that links of likeness `least` lead to.

    Equal fingerprints are one class from the start, and only one of them is compared. Pairs are found by their bands, with
    probability 1 - (1 - 0.75**DIGITS)**BANDS = 0.998 at 0.75 for each octave that they share, and confirmed on whole fingerprints. Empty fingerprints, and
    rows without a doc_id, are linked with nothing. A fingerprint's node is a 64-bit hash of it.
    """
    prints = prints.select("doc_id", "fingerprint")
    same = stored(prints.where("fingerprint <> '' AND doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("node")), "prints")
    same = same.withColumn("name", F.xxhash64("fingerprint"))
    keys = same.select(F.col("name").alias("node"), "fingerprint").mapInArrow(band_batches, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))
    keys = stored(keys.distinct(), "bands")
    shared = keys.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").drop("last")
    members = stored(keys.join(shared, "key"), "banded")
    text = same.select(F.col("name").alias("node"), "fingerprint")
    pairs = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(text.withColumnsRenamed({"node": "a", "fingerprint": "p"}), "a").join(text.withColumnsRenamed({"node": "b", "fingerprint": "q"}), "b")
    links = stored(pairs.select("a", "b", "p", "q").mapInArrow(verify(least), "a long, b long"), "links")
    comps = stored(components(links), "components")
    rows = members.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = rows.groupBy("key").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high AND members > 2")
    open_ = open_.select("key", F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    rows = stored(rows.join(open_, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "open-bands")
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", (F.col("other") < F.col("own")).cast("int"))
    cells = cells.withColumn("cell", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).join(text, "node")
    more = stored(cells.select("key", "cell", "node", "component", "fingerprint", "side").groupBy("key", "cell").applyInPandas(compare_cell(least), "a long, b long"), "links")
    comps = stored(components(links.unionByName(more)), "components")
    named_ = same.join(comps.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))
    ids = named_.groupBy("component").agg(F.min("node").alias("class_id"))
    ids = named_.join(ids, "component").select("fingerprint", "class_id")
    return prints.join(ids, "fingerprint", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
