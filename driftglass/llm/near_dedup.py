"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. Sets: a document's distinct `width`-word shingles, as 64-bit hashes of cryptographic digests of words. Documents with one set (a 128-bit digest of it) form
   a class; all that follows is about one document of each class.
2. Signatures: HASHES minima of the set. BANDS keys come from ROWS whole minima each; of every minimum the low BITS bits are
   kept and packed. The share of equal b-bit values, corrected for chance collisions, estimates the similarity.
3. Candidates: classes with a common band key. Everyone is first compared with one leader for each key, and confirmed on
   the whole sets; a group of many near copies is then one component already.
4. What is left, keys whose members lie in several components, is compared pair by pair inside tasks: bit counts over the
   packed signatures choose the pairs, whole sets confirm them, and only links that join components come out. A key's
   members are split in blocks of about BLOCK, so a task holds two blocks at most. Signatures (320 bytes) are dealt to all
   pairs of blocks first; whole sets follow only where a member has a likely partner.
5. Components come from repeated large-star and small-star steps over the links.

A pair at similarity 0.75 shares no key with probability (1 - 0.75**4)**32 = 5e-6, and at SLACK below the threshold an
estimate is 5 standard deviations off.

Scale: texts are read twice (sets; sets of candidates only), nothing is gathered by a hot key: keys are counted and led by
partial aggregates, members meet leaders in joins that Spark can split, and blocks bound what a task compares.

Cases: null, empty and wordless texts have no shingles and are linked with nothing; with fewer words than `width` the whole
sequence is the one shingle; rows that share a doc_id are linked, and each of their texts keeps its own links; a null doc_id gets a
null component, unless it is linked with a document that has one, and isn't kept; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass.llm.buffers import WordHashes, mix, row_pieces, utf8, word_hashes
from driftglass.llm.storage import broadcast_if_small, small_batches, stored

HASHES, BANDS, ROWS, BITS = 128, 32, 4, 4
SLACK, BLOCK = 0.2, 2048
WORD_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20011)
FACTORS = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of rows, in order within each row, and the bounds of the rows (rows + 1)."""
    rows = len(offsets) - 1
    w, edges = word_hashes(data, offsets, known)
    many = np.diff(edges)
    row = np.repeat(np.arange(rows), many)
    h = np.full(max(0, len(w) - width + 1), width, np.uint64)
    for j in range(width):
        h = mix(h * np.uint64(WORD_BASE) + w[j : len(h) + j])
    whole = row[: len(h)] == row[width - 1 :] if len(h) else np.zeros(0, bool)
    at, values = row[: len(h)][whole], h[whole]
    short = np.flatnonzero((many > 0) & (many < width))
    if len(short):
        own = many[short].astype(np.uint64)
        for j in range(width):
            some = many[short] > j
            own[some] = mix(own[some] * np.uint64(WORD_BASE) + w[edges[short[some]] + j])
        at, values = np.append(at, short), np.append(values, own)
        order = np.argsort(at, kind="stable")
        at, values = at[order], values[order]
    bounds = np.searchsorted(at, np.arange(rows + 1))
    sets = [np.unique(values[bounds[i] : bounds[i + 1]]) for i in range(rows)]
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.append(0, np.cumsum(sizes))


def minima(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """HASHES minima (columns) of each set (rows); sets aren't empty."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, HASHES), np.uint32)
    y = np.empty_like(x)
    for i in range(HASHES):
        np.multiply(x, FACTORS[i], out=y)
        np.bitwise_xor(y, SHIFTS[i], out=y)
        out[:, i] = np.minimum.reduceat(y, bounds[:-1])
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """BANDS keys of each signature."""
    m = m.astype(np.uint64).reshape(len(m), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), m.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key + m[:, :, r] * np.uint64(WORD_BASE))
    return key.view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of a mixed minimum, two to a byte: HASHES * BITS / 8 bytes for each signature."""
    low = (mix(m.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << 4)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (broadcast over the last axis): equal values less those that chance makes equal."""
    other = np.bitwise_xor(a, b)
    other |= other >> 1 & 0x77
    other |= other >> 2 & 0x33
    differ = np.bitwise_count((other & 0x11).view(np.uint64)).sum(axis=-1)
    chance = 1 / (1 << BITS)
    return ((HASHES - differ) / HASHES - chance) / (1 - chance)


def fixed(column: pa.Array) -> np.ndarray:
    """A column of packed signatures as rows of bytes."""
    data, offsets = column.buffers()[2], np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), HASHES * BITS // 8)


def binary(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))


SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, bits binary, bands array<long>"


def sign_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for r, s in row_pieces(offsets):
                at = offsets[r : s + 1]
                values, bounds = shingles(data[at[0] : at[-1]], at - at[0], width, known)
                size = np.diff(bounds)
                some = np.flatnonzero(size > 0)
                n = s - r
                bits = np.zeros((n, HASHES * BITS // 8), np.uint8)
                bands = np.zeros((0, BANDS), np.int64)
                if len(some):
                    starts = bounds[:-1][some]
                    m = minima(values, np.append(starts, len(values)))
                    bits[some], bands = packed(m), band_keys(m)
                ends = np.append(0, np.cumsum(np.where(size > 0, BANDS, 0)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(r, n), pa.array(size), *(pa.array(x) for x in digests(values, bounds)), binary(bits), lists(bands.ravel(), ends)],
                    names=["doc_id", "n_shingles", "d1", "d2", "bits", "bands"],
                )

    return run


def digests(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits of each set as two rows of longs; 0 for an empty one."""
    size = np.diff(bounds)
    some = np.flatnonzero(size > 0)
    d = np.zeros((2, len(size)), np.uint64)
    if len(some):
        starts = bounds[:-1][some]
        d[0, some] = mix(np.add.reduceat(mix(values), starts) + size[some].astype(np.uint64))
        d[1, some] = mix(np.add.reduceat(mix(values ^ np.uint64(WORD_BASE)), starts) ^ mix(size[some].astype(np.uint64)))
    return d.view(np.int64)


def set_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for r, s in row_pieces(offsets):
                at = offsets[r : s + 1]
                values, bounds = shingles(data[at[0] : at[-1]], at - at[0], width, known)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(r, s - r), pa.array(digests(values, bounds)[0]), lists(values.view(np.int64), bounds)], names=["doc_id", "d1", "hashes"])

    return run


def overlap(p: np.ndarray, q: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(p) < len(q):
        p, q = q, p
    at = np.searchsorted(p, q)
    at[at == len(p)] = 0
    return int((p[at] == q).sum())


def values_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a list column, flat, and the bounds of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    bounds = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False).view(np.uint64), bounds


def overlap_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (x, at_x), (y, at_y) = values_of(batch.column("x")), values_of(batch.column("y"))
        common = [overlap(x[at_x[i] : at_x[i + 1]], y[at_y[i] : at_y[i + 1]]) for i in range(len(batch))]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(np.diff(at_x)), pa.array(np.diff(at_y))], names=["a", "b", "common", "na", "nb"])


def estimate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        est = estimate(fixed(batch.column("p")), fixed(batch.column("q")))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(est)], names=["a", "b", "est"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b) of nodes, those whose sets reach the similarity."""
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    both = both.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").select("a", "b", "x", "y")
    met = both.mapInArrow(overlap_batches, "a long, b long, common long, na long, nb long")
    return met.where(F.col("common") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every node links its greater neighbours to the least node around it; small: the same with its lesser ones."""
    if large:
        ways = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        ways = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = ways.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    met = ways.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node of edges(a, b) that isn't its own component."""
    edges = stored(edges.where("a <> b"), "edges")
    before = None
    while True:
        edges = stored(star(star(edges, large=True), large=False), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.col("b").cast("decimal(20,0)")).alias("s"), F.count_distinct("a").alias("d"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h")).first()
        if now == before or not now.n:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def likely_pairs(rows: pa.Table, least: float, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a cell's members (places) of different components and of high estimate, and the estimates.

    A pair with several common keys is compared at the first of them alone.
    """
    comp, n, side, bands_at = (rows.column(c).to_numpy() for c in ("component", "n_shingles", "side", "band"))
    bits = fixed(rows.column("bits").combine_chunks())
    bands = values_of(rows.column("bands"))[0].reshape(-1, BANDS)
    left = np.flatnonzero(side == 0)
    lone = len(left) == len(side)  # a block against itself
    right = left if lone else np.flatnonzero(side == 1)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for a in range(0, len(left), 32):
        i = left[a : a + 32]
        ok = (comp[i][:, None] != comp[right][None]) & (100 * np.minimum(n[i][:, None], n[right][None]) >= percent * np.maximum(n[i][:, None], n[right][None]))
        if lone:
            ok &= i[:, None] < right[None]
        p, q = np.nonzero(ok)
        p, q = i[p], right[q]
        est = estimate(bits[p], bits[q])
        p, q, est = p[est >= least], q[est >= least], est[est >= least]
        first = (bands[p] == bands[q]).argmax(axis=1) == bands_at[p]
        found.append((p[first], q[first], est[first]))
    return tuple(np.concatenate(x) for x in zip(*found))


def open_members(rows: pa.Table, least: float, percent: int) -> pa.RecordBatch:
    """The members of a cell that a likely pair holds."""
    p, q, _ = likely_pairs(rows, least, percent)
    names = ["key", "cell", "side", "band", "node", "component", "n_shingles"]
    return rows.select(names).take(pa.array(np.union1d(p, q))).combine_chunks().to_batches()


def compare_cell(rows: pa.Table, least: float, percent: int) -> list[pa.RecordBatch]:
    """Links that join components among the members of a cell: likely pairs, the likeliest first, confirmed on the whole
    sets unless they are connected by then."""
    node, comp, n = (rows.column(c).to_numpy() for c in ("node", "component", "n_shingles"))
    hashes, bounds = values_of(rows.column("hashes"))
    p, q, est = likely_pairs(rows, least, percent)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    links = []
    for k in np.argsort(-est, kind="stable"):
        i, j = int(p[k]), int(q[k])
        a, b = root(int(comp[i])), root(int(comp[j]))
        if a != b:
            common = overlap(hashes[bounds[i] : bounds[i + 1]], hashes[bounds[j] : bounds[j + 1]])
            if 100 * common >= percent * (n[i] + n[j] - common):
                parent[max(a, b)] = min(a, b)
                links.append((int(node[i]), int(node[j])))
    a, b = zip(*links) if links else ((), ())
    return [pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])]


def by_cell(f, least: float, percent: int):
    """f(rows, least, percent) for each cell of rows that come sorted by key and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            at = np.stack([table.column(c).to_numpy() for c in ("key", "cell")])
            first = 0
            for cut in np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1:
                yield from f(table.slice(first, cut - first), least, percent)
                first = int(cut)
            held = table.slice(first)
        if held is not None and len(held):
            yield from f(held, least, percent)

    return run


def links_across(members: DataFrame, about: DataFrame, sets: DataFrame, comps: DataFrame, least: float, percent: int, block: int) -> DataFrame:
    """Links between components among the members(key, band, node, n_shingles) of keys of more than two."""
    rows = members.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    keys = rows.groupBy("key").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("words"), F.min("component").alias("low"), F.max("component").alias("high"))
    keys = keys.where("low <> high AND members > 2").select("key", F.ceil(F.greatest(F.col("members") / block, F.col("words") / (block * 512))).cast("int").alias("blocks"))
    rows = stored(rows.join(keys, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "open-keys")
    # a cell is a pair of blocks i <= j; a member of block o stands left in the cells (o, j) and right in (i, o)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = rows.withColumn("other", other).withColumn("side", (F.col("other") < F.col("own")).cast("int"))
    cells = cells.withColumn("cell", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    columns = ["key", "cell", "side", "band", "node", "component", "n_shingles"]
    bits = about.select("node", "bits", "bands")
    dealt = lambda x: x.repartition("key", "cell").sortWithinPartitions("key", "cell", "side", "node")
    # signatures go to every cell of a member, whole sets only to those in which it has a likely partner
    kinds = "key long, cell int, side int, band int, node long, component long, n_shingles long"
    likely = stored(dealt(cells.select(columns).join(bits, "node")).mapInArrow(by_cell(open_members, least, percent), kinds), "likely")
    return dealt(likely.join(bits, "node").join(sets, "node")).mapInArrow(by_cell(compare_cell, least, percent), "a long, b long")


NAMELESS = 1 << 62  # nodes of classes without a doc_id lie above all others


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs(doc_id, text); links need percent similarity."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    least = percent / 100 - SLACK
    signed = stored(docs.mapInArrow(sign_batches(width), SIGNED), "signed")
    digest = ["d1", "d2"]
    full = signed.where("n_shingles > 0")
    nameless = F.col("d1").bitwiseAND(NAMELESS - 1).bitwiseOR(NAMELESS)
    classes = full.groupBy(*digest).agg(F.coalesce(F.min("doc_id"), F.min(nameless)).alias("least"))
    # a class is a node by its least doc_id; where that stands for several texts, one keeps it and the others get nodes of their own
    ids = full.where("doc_id IS NOT NULL").groupBy("doc_id")
    ids = ids.agg(F.min(F.struct(*digest)).alias("one"), F.max(F.struct(*digest)).alias("other")).where("one <> other").select("doc_id")
    ids = stored(ids, "ids-of-several-texts")
    repeated = bool(ids.take(1))
    if repeated:
        tops = classes.join(ids.withColumnRenamed("doc_id", "least"), "least").groupBy("least").agg(F.max(F.struct(*digest)).alias("top"))
        classes = classes.join(tops, "least", "left").withColumn("node", F.when(F.struct(*digest) != F.col("top"), nameless).otherwise(F.col("least"))).drop("top")
    else:
        classes = classes.withColumn("node", F.col("least"))
    classes = stored(classes.select(*digest, "least", "node"), "classes")
    # one row stands for each class
    one = full.withColumn("least", F.coalesce("doc_id", nameless)).drop("doc_id").join(classes, [*digest, "least"])
    keyed = one.select("node", "n_shingles", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").drop("last")
    led = stored(keyed.join(shared, "key").select("key", "band", "leader", "node", "n_shingles"), "led")
    about = one.join(led.select("node").distinct(), "node", "left_semi")
    about = about.groupBy("node").agg(F.max(F.struct(*digest, "n_shingles", "bits", "bands", "least")).alias("one")).select("node", "one.*")
    about = stored(about, "candidates")

    # whole sets, of the candidates alone
    named = about.where(F.col("least") < NAMELESS).select(F.col("least").alias("doc_id"))
    texts = docs.join(broadcast_if_small(named), "doc_id", "left_semi").select("doc_id", "text")
    if about.where(F.col("least") >= NAMELESS).take(1):
        texts = texts.unionByName(docs.where("doc_id IS NULL"))
    sets = texts.mapInArrow(set_batches(width), "doc_id long, d1 long, hashes array<long>").withColumn("least", F.coalesce("doc_id", nameless))
    sets = stored(sets.join(about.select("node", "least", "d1"), ["least", "d1"]).dropDuplicates(["node"]).select("node", "hashes"), "sets")

    pairs = led.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    small = about.select("node", F.col("n_shingles").alias("n"), "bits")
    pairs = pairs.join(small.withColumnsRenamed({"node": "a", "n": "na", "bits": "p"}), "a").join(small.withColumnsRenamed({"node": "b", "n": "nb", "bits": "q"}), "b")
    pairs = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    pairs = pairs.mapInArrow(estimate_batches, "a long, b long, est double").where(F.col("est") >= least)
    links = confirmed(pairs, sets, percent)
    if repeated:  # texts of one doc_id are one document
        own = full.join(ids, "doc_id").join(classes, digest).select("doc_id", "node").distinct()
        links = links.unionByName(own.join(own.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a <> node").select("a", F.col("node").alias("b")))
    links = stored(links, "links")
    comps = stored(components(links), "components")
    members = led.select("key", "band", "node", "n_shingles")
    more = stored(links_across(members, about, sets, comps, least, percent, block), "links")
    comps = stored(components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "components")

    rows = signed.select("doc_id", "n_shingles", *digest).join(classes, digest, "left").join(comps, "node", "left")
    least_id = F.coalesce("component", "node")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(least_id < NAMELESS, least_id)
    rows = rows.select("doc_id", "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
