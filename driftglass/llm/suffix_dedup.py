"""Removal of byte strings that occur more than once in a corpus, by a logarithmic family of sparse suffix arrays.

A string of `length` bytes is judged by its anchor: of its SEED-byte substrings, the leftmost one with the smallest hash.
Equal strings have the same anchor at the same offset, so it is enough to index the suffixes that start at anchors, about
one in 85 positions, and to keep for each the stretch of strings that it is the anchor of (its reach).

* Every batch of documents becomes a suffix array: its anchors' suffixes in one order over all of the array's parts, by
  content (the first eight bytes, then the hash of the first SEED bytes, then that of the reach). Its directory lists the
  runs of suffixes with a common start: how many there are, and the least and greatest reach.
* A new array is merge-scanned against every level: the sorted directories are merged on the start, which finds the suffixes
  that share one with the level or in the array itself. Runs whose reaches are all equal match over the whole reach.
* Then the last level is merged with the one before as long as that has not MERGE times its rows, so levels grow
  geometrically and a row is rewritten about log2(batches) times.
* The levels' manifest (paths and rows) lies beside them, so a later session can open the index and append a batch.

Suffixes that share a start but not the whole reach (the rims of a repeated passage) are compared string by string: one
suffix for each distinct content gets the hash of every string it reaches, and Spark counts those.

Nothing is gathered by key in one task: runs are counted by partial aggregates, arrays are cut between parts wherever their
order says, in the middle of a run too, and hot keys meet only in joins that Spark can split. Starts, reaches and strings are
equal if two polynomial hashes modulo a prime are, for the start and for what follows it: 124 bits.

Cases: null and empty texts, and those shorter than `length`, lose nothing; a document that repeats itself is treated like
any other repeat; equal rows are copies of each other. Rows that share a doc_id (null included) are told apart by a digest of
their texts, so each is cut where it repeats. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.llm.buffers import BYTE_VALUE, mix, powers, prefix_sums, sound_hash, sound_sums, utf8
from driftglass.llm.storage import dropped, shared_dir, stored

SEED = 32
CHUNK = 1 << 17
MERGE = 1.5
PLACE_BASE = 0x9E3779B97F4A7C15
ROW = ["rid", "tag"]  # tells rows apart: doc_id and 32 bits of a digest of the text, 96 bits of it where doc_id is null
ORDER = ["head", "key", "reach", *ROW, "start"]
ENTRY = "head long, key long, reach long, rid long, tag int, start int, n int"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours, by running minima within blocks from both sides."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, row_of_start: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of the strings that start at each position where valid: head, key, reach, first start and number, one for each anchor."""
    w = length - SEED + 1
    sums = prefix_sums(BYTE_VALUE[data], PLACE_BASE)
    at = np.arange(len(data) - SEED + 1)
    places = mix((sums[SEED:] - sums[:-SEED]) * powers(PLACE_BASE, len(sums))[1][: len(at)])
    bits = np.uint64(max(1, int(len(places)).bit_length()))
    low = sliding_min(((places >> bits) << bits) | at.astype(np.uint64), w)
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)[: len(valid)]
    new = np.ones(len(valid), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row_of_start[1:] != row_of_start[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    # strings that are not valid end a run as well
    stops = np.flatnonzero(np.append(new | ~valid, True))
    end = stops[np.searchsorted(stops, first, side="right")]
    found = anchor[first]
    sound = sound_sums(data)
    key = sound_hash(sound, found, found + SEED)
    reach = mix(sound_hash(sound, first, end - 1 + length) + (found - first).astype(np.uint64))
    head = data[found[:, None] + np.arange(8)].copy().view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)
    return head.view(np.int64), key.view(np.int64), reach.view(np.int64), first, end - first


def row_keys(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rid and tag of a batch's rows."""
    made = b"".join(hashlib.blake2b(data[a:b], digest_size=12).digest() for a, b in zip(offsets, offsets[1:]))
    made = np.frombuffer(made, np.int32).reshape(-1, 3)
    column = batch.column("doc_id")
    rid = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if column.null_count:
        none = column.is_null().to_numpy(zero_copy_only=False)
        rid[none] = made[none, :2].copy().view(np.int64).ravel()
    return rid, made[:, 2]


def keyed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and text with the rows' keys."""
    for batch in batches:
        rid, tag = row_keys(batch, *utf8(batch.column("text")))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rid), pa.array(tag)], names=[*batch.schema.names, *ROW])


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(keyed_batches, "doc_id long, text string, rid long, tag int")


def stretches(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Byte ranges to scan: each has CHUNK starts of strings, and the length - 1 bytes after them."""
    total = int(offsets[-1])
    for a in range(0, total, CHUNK):
        yield a, min(total, a + CHUNK + length - 1)


def index_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            rid, tag = row_keys(batch, data, offsets)
            for a, b in stretches(offsets, length):
                if b - a < length:
                    continue
                last = b - length + 1
                first_row = int(np.searchsorted(offsets, a, side="right")) - 1
                last_row = int(np.searchsorted(offsets, last, side="left"))
                edges = offsets[first_row : last_row + 1].clip(a, last)
                many = np.diff(edges)
                row = np.repeat(np.arange(first_row, last_row), many)
                valid = np.arange(a, last) + length <= np.repeat(offsets[first_row + 1 : last_row + 1], many)
                if not valid.any():
                    continue
                head, key, reach, first, n = anchors(data[a:b], row, valid, length)
                at = row[first]
                values = (head, key, reach, rid[at], tag[at], (first + a - offsets[at]).astype(np.int32), n.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in values], names=["head", "key", "reach", *ROW, "start", "n"])

    return run


def in_order(entries: DataFrame) -> DataFrame:
    """One order over all parts. Ranges are found by a sample of `entries`, which are to be a stored table."""
    return entries.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)


def suffix_array(docs: DataFrame, length: int = 200) -> DataFrame:
    """The sparse suffixes of docs(doc_id, text) in order, as a stored table."""
    entries = stored(docs.select("doc_id", "text").mapInArrow(index_batches(length), ENTRY), "suffixes")
    array = stored(in_order(entries), "array")
    dropped(entries)
    return array


def directory(array: DataFrame) -> DataFrame:
    """The runs of an array (or several): key, suffixes, low, high. A run that parts divide is put together again."""
    met = array.groupBy("key").agg(F.count("*").alias("suffixes"), F.min("reach").alias("low"), F.max("reach").alias("high"))
    return stored(met, "directory")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """The merge of two directories: the runs of both."""
    met = a.unionByName(b).groupBy("key")
    return stored(met.agg(F.sum("suffixes").alias("suffixes"), F.min("low").alias("low"), F.max("high").alias("high")), "directory")


class SuffixIndex:
    """Levels (rows, array, directory), from the largest to the smallest, and the starts that scans have matched."""

    def __init__(self, spark: SparkSession, length: int = 200):
        self.spark, self.length = spark, length
        self.levels: list[tuple[int, DataFrame, DataFrame]] = []
        self.matched: list[DataFrame] = []

    def append(self, docs: DataFrame) -> None:
        """Adds a batch: builds its array, scans it against all levels, and merges levels that are too near in size."""
        array = suffix_array(docs, self.length)
        runs_of = directory(array)
        found = runs_of.where("suffixes > 1").select("key")
        for _, _, level in self.levels:
            found = found.unionByName(runs_of.join(level.select("key"), "key").select("key"))
        self.matched.append(stored(found.distinct(), "matched"))
        self.levels.append((array.count(), array, runs_of))
        while len(self.levels) > 1 and self.levels[-1][0] * MERGE > self.levels[-2][0]:
            (n, a, p), (m, b, q) = self.levels.pop(), self.levels.pop()
            self.levels.append((n + m, stored(in_order(a.unionByName(b)), "array"), both(p, q)))
            for old in (a, b, p, q):
                dropped(old)

    def save(self, path: str) -> None:
        """Writes the manifest: the tables of the levels and of the matched starts."""
        rows = [("level", n, a.inputFiles(), d.inputFiles()) for n, a, d in self.levels] + [("matched", None, m.inputFiles(), []) for m in self.matched]
        made = self.spark.createDataFrame(rows, "kind string, rows long, files array<string>, directory array<string>")
        made.coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, length: int = 200) -> SuffixIndex:
        out = cls(spark, length)
        runs_of = "key long, suffixes long, low long, high long"
        read = lambda kind, files: spark.read.schema(kind).parquet(*files) if files else spark.createDataFrame([], kind)
        for r in sorted(spark.read.parquet(path).collect(), key=lambda r: -(r.rows or 0)):  # a row for each table
            if r.kind == "level":
                out.levels.append((r.rows, read(ENTRY, r.files), read(runs_of, r.directory)))
            else:
                out.matched.append(read("key long", r.files))
        return out

    def entries(self) -> DataFrame:
        out = self.levels[0][1]
        for _, level, _ in self.levels[1:]:
            out = out.unionByName(level)
        return out

    def repeated(self) -> tuple[DataFrame, DataFrame]:
        """Suffixes with partners: those that match over their whole reach, and one each of the contents to compare."""
        keys = self.matched[0]
        for m in self.matched[1:]:
            keys = keys.unionByName(m)
        runs_of = self.levels[0][2]
        for _, _, more in self.levels[1:]:
            runs_of = runs_of.unionByName(more)
        runs_of = runs_of.join(keys.distinct(), "key", "left_semi").groupBy("key").agg((F.min("low") == F.max("high")).alias("same"))
        # stored, so that both sides of the join come straight from exchanges and Spark can split a hot start
        hits = stored(self.entries().drop("head").join(stored(runs_of, "runs"), "key"), "hits")
        whole = hits.where("same").select(*ROW, "start", "n")
        mixed = hits.where("NOT same")
        contents = mixed.groupBy("key", "reach").agg(F.count("*").alias("copies"), F.min(F.struct(*ROW, "start", "n")).alias("one"))
        contents = stored(contents.select("key", "reach", "copies", "one.*"), "contents")
        many = stored(contents.where("copies > 1").select("key", "reach"), "many")
        whole = whole.unionByName(mixed.join(many, ["key", "reach"], "left_semi").select(*ROW, "start", "n"))
        return whole, contents


def content_batches(length: int):
    """The bytes that each listed suffix of a row reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            listed = batch.column("suffixes")
            flat = listed.flatten()
            row = np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy()))
            start, n = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("start", "n"))
            begin = offsets[row] + start
            size = n.astype(np.int64) + length - 1
            for a in range(0, len(row), 4096):
                some = slice(a, a + 4096)
                ends = np.cumsum(size[some])
                at = np.arange(ends[-1]) + np.repeat(begin[some] - ends + size[some], size[some])
                reached = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])
                of_row = pa.array(row[some])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x).take(of_row) for x in ROW), pa.array(start[some]), pa.array(n[some]), flat.field("key")[some], flat.field("copies")[some], reached],
                    names=[*ROW, "start", "n", "key", "copies", "bytes"],
                )

    return run


def string_hashes(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every string that a batch's contents reach: its hash, its content's row, and its place there."""
    column = batch.column("bytes")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    n = batch.column("n").to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = (offsets - offsets[0])[row] + place
    return sound_hash(sound_sums(data), begin, begin + length), row, place


def runs(batch: pa.RecordBatch, row: np.ndarray, place: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
    """Strings found again, as stretches of neighbouring starts."""
    row, place = row[again], place[again]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(row)))
    start = batch.column("start").to_numpy(zero_copy_only=False)[row[first]]
    of_row = pa.array(row[first])
    return pa.RecordBatch.from_arrays([*(batch.column(x).take(of_row) for x in ROW), pa.array((start + place[first]).astype(np.int32)), pa.array(many.astype(np.int32))], names=[*ROW, "start", "n"])


def compare_sorted(length: int, at_once: int = 2000):
    """Strings that occur more than once among the contents of a key. Rows come sorted by key."""

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, row, place = string_hashes(batch, length)
        copies = batch.column("copies").to_numpy(zero_copy_only=False)[row]
        keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
        _, inverse = np.unique(h ^ mix(keys)[row], return_inverse=True)
        again = np.bincount(inverse, weights=np.minimum(copies, 2))[inverse] > 1
        return runs(batch, row, place, again & (copies == 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for a in range(0, len(batch), at_once):
                held.append(batch.slice(a, at_once))
                table = pa.concat_batches(held)
                keys = table.column("key").to_numpy(zero_copy_only=False)
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                if cut:
                    yield judged(table.slice(0, cut))
                    table = pa.concat_batches([table.slice(cut)])
                held = [table]
        if held and len(held[0]):
            yield judged(pa.concat_batches(held))

    return run


def hash_contents(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1000):
                some = pa.concat_batches([batch.slice(a, 1000)])
                h, row, place = string_hashes(some, length)
                key, start, copies = (some.column(x).to_numpy(zero_copy_only=False)[row] for x in ("key", "start", "copies"))
                of_row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(h.view(np.int64)), *(some.column(x).take(of_row) for x in ROW), pa.array((start + place).astype(np.int32)), pa.array(copies)],
                    names=["key", "string", *ROW, "start", "copies"],
                )

    return run


STRETCH = "rid long, tag int, start int, n int"


def rim_matches(docs: DataFrame, contents: DataFrame, length: int, group_most: int) -> DataFrame:
    """Strings that contents with a common key share, as stretches of rows of docs(doc_id, text, rid, tag).

    A key's contents are compared in one task up to group_most of them, key after key in sorted order. Beyond that the
    strings themselves are counted by Spark, whatever their number.
    """
    # rows that repeat as a whole are read each, their contents listed once; those have two copies, so that changes nothing
    listed = contents.groupBy(*ROW).agg(F.collect_set(F.struct("start", "n", "key", "copies")).alias("suffixes"))
    reached = docs.join(listed, ROW).select(*ROW, "text", "suffixes").mapInArrow(content_batches(length), STRETCH + ", key long, copies long, bytes binary")
    reached = stored(reached, "contents")
    crowded = contents.groupBy("key").count().where(F.col("count") > group_most).select("key")
    few = reached.join(crowded, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    many = reached.join(crowded, "key", "left_semi").mapInArrow(hash_contents(length), "key long, string long, rid long, tag int, start int, copies long")
    again = many.groupBy("key", "string").agg(F.sum("copies").alias("total")).where("total > 1").select("key", "string")
    strings = many.where("copies = 1").join(again, ["key", "string"], "left_semi").select(*ROW, "start", F.lit(1).alias("n"))
    return few.mapInArrow(compare_sorted(length), STRETCH).unionByName(strings)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def cut_batches(length: int, with_text: bool):
    """Removes every byte that a listed string covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            listed = batch.column("marks")
            if len(batch) and listed.null_count == len(listed):
                flat_start = flat_n = np.zeros(0, np.int64)
                edges = np.zeros(len(batch) + 1, np.int64)
            else:
                edges = listed.offsets.to_numpy().astype(np.int64)
                values = listed.values
                flat_start, flat_n = (values.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("start", "n"))
            removed, spans, shas, kept = [], [], [], []
            for i in range(len(batch)):
                text = data[offsets[i] : offsets[i + 1]]
                start, n = flat_start[edges[i] : edges[i + 1]], flat_n[edges[i] : edges[i + 1]]
                if len(start):
                    change = np.zeros(len(text) + 1, np.int32)
                    np.add.at(change, np.minimum(start, len(text)), 1)
                    np.add.at(change, np.minimum(start + n + length - 1, len(text)), -1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed.append(int(gone.sum()))
                    spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    text = text[~gone]
                else:
                    removed.append(0)
                    spans.append(0)
                shas.append(hashlib.sha256(text).hexdigest())
                kept.append(text.tobytes() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def suffix_dedup(docs: DataFrame, length: int = 200, batches: int = 3, group_most: int = 20_000, with_text: bool = True) -> DataFrame:
    """One row per document of docs(doc_id, text): how many bytes repeated strings take, and what is left.

    The documents are added to a SuffixIndex in `batches` batches, by a hash of doc_id; the result doesn't depend on them.
    """
    index = SuffixIndex(docs.sparkSession, length)
    for i in range(batches):
        index.append(docs.where(F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(batches)), F.lit(0)) == i))
    whole, contents = index.repeated()
    rows = keyed(docs)
    marks = whole.unionByName(rim_matches(rows, contents, length, group_most))
    marks = marks.groupBy(*ROW).agg(F.collect_set(F.struct("start", "n")).alias("marks"))  # equal rows have equal marks, held once
    return rows.join(marks, ROW, "left").mapInArrow(cut_batches(length, with_text), RESULT)
