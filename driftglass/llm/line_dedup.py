"""Removal of lines that many documents share, kept reversible by exact reference counts.

* Every line has a key: its text without white space at both ends, A-Z in lower case. An exact table counts for each key
  the documents that hold it; documents added or deleted later add or subtract their part (`updated_counts`).
* Keys at or above the threshold sit in cuckoo filters, one per shard of keys. A filter takes insertions and deletions,
  so keys that cross the threshold either way move in or out (`updated_filters`) without a rebuild.
* Lines are judged by the filters, backed by the counts: the few keys of the table that a filter accepts wrongly are
  listed as exceptions. While filters and exceptions stay under a size bound they go to every executor and texts are never
  shuffled; beyond it, lines meet the counts in a join and only its matches are attached to the documents.

Keys are 128-bit cryptographic digests, so two lines with one key are taken to be equal whatever their texts, and they are
counted by partial aggregates, so a line that every document holds is no hot spot.

Cases: a null or empty text is one empty line, and it stays (keys have at least min_chars code points, 1 or more); a key
counts once for a document, however often it occurs there; every row is a document, even if it repeats a doc_id or a whole
row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass.llm.buffers import mix, utf8
from driftglass.llm.storage import dropped, small_batches, stored

KEY = "k1 long, k2 long"
SPACE = b" \t\n\x0b\x0c\r"
SLOTS = 4
KEYS_PER_SHARD = 100_000
FILTER_BYTES_MOST = 64 << 20
EXCEPTIONS_MOST = 100_000
PIECE = 1 << 20
FOUND = "_found_keys"


def normal(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # of bytes, A-Z alone change


def line_keys(keys: list[bytes], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the digests of normal lines, and whether they are long enough (counted in code points)."""
    made = np.frombuffer(b"".join([hashlib.blake2b(k, digest_size=16).digest() for k in keys]), np.int64).reshape(-1, 2)
    if min_chars <= 1:
        long = np.fromiter(map(len, keys), np.int64, len(keys)) >= min_chars
    else:
        long = np.fromiter((len(k.decode()) for k in keys), np.int64, len(keys)) >= min_chars
    return made[:, 0], made[:, 1], long


def split_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The lines of a batch's texts, of rows of about PIECE bytes at a time, with the first row's place."""
    data, offsets = utf8(batch.column("text"))
    first, size, held = 0, 0, []
    for i in range(len(batch)):
        held.append(data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n"))
        size += int(offsets[i + 1] - offsets[i])
        if size >= PIECE or i + 1 == len(batch):
            yield first, held
            first, size, held = i + 1, 0, []


def key_batches(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows in split_rows(batch):
                k1, k2, long = line_keys([key for lines in rows for key in {normal(x) for x in lines}], min_chars)
                yield pa.RecordBatch.from_arrays([pa.array(k1[long]), pa.array(k2[long])], names=["k1", "k2"])

    return run


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """The reference counts of docs(text): k1, k2, docs."""
    return docs.select("text").mapInArrow(key_batches(min_chars), KEY).groupBy("k1", "k2").agg(F.count("*").alias("docs"))


def updated_counts(counts: DataFrame, added: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Counts after documents came or went, given as counts of their own; keys that no document holds any more go."""
    for change, sign in ((added, 1), (deleted, -1)):
        if change is not None:
            counts = counts.unionByName(change.select("k1", "k2", (F.col("docs") * sign).alias("docs")))
    return counts.groupBy("k1", "k2").agg(F.sum("docs").alias("docs")).where("docs > 0")


class CuckooFilter:
    """32-bit marks in buckets of four; a mark's two buckets are each other's image, so marks can move and be deleted."""

    def __init__(self, buckets: int):
        self.table = np.zeros((1 << max(1, int(buckets - 1).bit_length()), SLOTS), np.uint32)

    @classmethod
    def of(cls, k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
        buckets = max(2, int(len(k1) / (SLOTS * 0.85)) + 1)
        while True:
            out = cls(buckets)
            if out.insert(k1, k2):
                return out
            buckets = 2 * len(out.table)

    @classmethod
    def read(cls, raw: bytes) -> CuckooFilter:
        out = cls(2)
        out.table = np.frombuffer(raw, np.uint32).reshape(-1, SLOTS).copy()
        return out

    def places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        mark = (k2.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        mark[mark == 0] = 1
        first = mix(k1.view(np.uint64)) & mask
        return mark, first, (first ^ mix(mark.astype(np.uint64))) & mask

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """False if a mark found no place; the filter is then to be built anew, larger."""
        table, mask = self.table, np.uint64(len(self.table) - 1)
        for mark, first, second in zip(*self.places(k1, k2)):
            for at in (first, second):
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = mark
                    break
            else:
                at = first
                for kick in range(500):
                    slot = (int(mark) + kick) % SLOTS
                    mark, table[at, slot] = table[at, slot], mark
                    at = (at ^ mix(np.array([mark], np.uint64))[0]) & mask
                    free = np.flatnonzero(table[at] == 0)
                    if len(free):
                        table[at, free[0]] = mark
                        break
                else:
                    return False
        return True

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        for mark, first, second in zip(*self.places(k1, k2)):
            for at in (first, second):
                held = np.flatnonzero(self.table[at] == mark)
                if len(held):
                    self.table[at, held[0]] = 0
                    break

    def holds(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, first, second = self.places(k1, k2)
        return ((self.table[first] == mark[:, None]) | (self.table[second] == mark[:, None])).any(axis=1)


def build_filters(hot: DataFrame, shards: int) -> DataFrame:
    """One filter for each shard of the keys in hot: shard, filter."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.of(rows.k1.to_numpy(np.int64), rows.k2.to_numpy(np.int64))
        return pd.DataFrame({"shard": rows.shard[:1], "filter": [made.table.tobytes()]})

    keys = hot.select(F.pmod("k1", F.lit(shards)).cast("int").alias("shard"), "k1", "k2")
    return keys.groupBy("shard").applyInPandas(build, "shard int, filter binary")


def updated_filters(filters: DataFrame, before: DataFrame, after: DataFrame, shards: int, min_docs: int = 10) -> DataFrame:
    """Filters after the counts changed: keys that fell under min_docs are deleted, keys that reached it are inserted."""
    old, new = (x.where(F.col("docs") >= min_docs).select("k1", "k2") for x in (before, after))
    gone, come = old.join(new, ["k1", "k2"], "left_anti"), new.join(old, ["k1", "k2"], "left_anti")
    moved = gone.withColumn("come", F.lit(False)).unionByName(come.withColumn("come", F.lit(True)))
    moved = moved.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int"))
    left = new.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int"))

    def move(held: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        shard = int((held if len(held) else rows).shard.iloc[0])
        out = CuckooFilter.read(held["filter"].iloc[0]) if len(held) else CuckooFilter(len(rows))
        keys = [(x.k1.to_numpy(np.int64), x.k2.to_numpy(np.int64)) for x in (rows[~rows.come.astype(bool)], rows[rows.come.astype(bool)])]
        out.delete(*keys[0])
        full = not out.insert(*keys[1])
        return pd.DataFrame({"shard": [shard], "filter": [None if full else out.table.tobytes()]})

    out = filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(move, "shard int, filter binary")
    out = stored(out, "filters")
    full = out.where("filter IS NULL").select("shard")
    return out.where("filter IS NOT NULL").unionByName(build_filters(left.join(full, "shard", "left_semi"), shards))


def wrongly_held(held: dict[int, bytes], shards: int):
    """Keys that the filters accept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {k: CuckooFilter.read(v) for k, v in held.items()}
        for batch in batches:
            k1, k2 = (batch.column(x).to_numpy() for x in ("k1", "k2"))
            yield batch.filter(pa.array(accepted(filters, shards, k1, k2)))

    return run


def accepted(filters: dict[int, CuckooFilter], shards: int, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    out = np.zeros(len(k1), bool)
    shard = k1 % shards
    for s in np.unique(shard):
        if int(s) in filters:
            at = np.flatnonzero(shard == s)
            out[at] = filters[int(s)].holds(k1[at], k2[at])
    return out


def cut_batches(drops, min_chars: int, digest: bool):
    """Rows without the lines that drops(batch) -> (row, k1, k2) -> bool says to drop: all columns with the new text, or a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            judge = drops(batch)
            many, gone, kept = [], [], []
            for first, rows in split_rows(batch):
                sizes = np.array([len(x) for x in rows])
                k1, k2, long = line_keys([normal(x) for lines in rows for x in lines], min_chars)
                drop = long & judge(first + np.repeat(np.arange(len(rows)), sizes), k1, k2)
                ends = np.cumsum(sizes)
                dropped = np.add.reduceat(drop.astype(np.int64), ends - sizes)
                many.append(sizes)
                gone.append(dropped)
                for lines, end, n in zip(rows, ends, dropped):
                    kept.append(b"\n".join([x for x, d in zip(lines, drop[end - len(lines) : end]) if not d] if n else lines))
            if not digest:
                names = [x for x in batch.schema.names if x != FOUND]
                text = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([text if x == "text" else batch.column(x) for x in names], names=names)
                continue
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(many)), pa.array(np.concatenate(gone)), pa.array([hashlib.sha256(x).hexdigest() for x in kept])],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return run


DIGEST = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def grown(docs: DataFrame, min_docs: int, min_chars: int, batches: int) -> tuple[DataFrame, DataFrame, int]:
    """Counts, filters and the number of shards after docs came in `batches` batches, by a hash of doc_id."""
    hot = lambda counts: counts.where(F.col("docs") >= min_docs)
    part = lambda i: docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i)
    counts = stored(line_counts(part(0), min_chars), "line-counts")
    shards = max(1, -(-hot(counts).count() * batches // KEYS_PER_SHARD))
    filters = build_filters(hot(counts), shards)
    for i in range(1, batches):
        after = stored(updated_counts(counts, added=line_counts(part(i), min_chars)), "line-counts")
        filters = stored(updated_filters(filters, counts, after, shards, min_docs), "filters")
        dropped(counts)
        counts = after
    return counts, filters, shards


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, filter_bytes_most: int = FILTER_BYTES_MOST, digest: bool = False, batches: int = 2) -> DataFrame:
    """docs without the lines of keys in min_docs documents or more: its columns with what is left as text (a null text: '').

    With digest, of docs(doc_id, text): doc_id, n_lines, n_dropped, kept_sha256. Counts and filters grow over `batches`
    batches of documents; the result doesn't depend on their number.
    """
    small_batches(docs.sparkSession)
    counts, filters, shards = grown(docs, min_docs, min_chars, batches)
    hot = counts.where(F.col("docs") >= min_docs)
    n_hot = hot.count()
    rows = docs.select("doc_id", "text") if digest else docs
    schema = DIGEST if digest else docs.schema
    if n_hot * 4 * 3 <= filter_bytes_most:
        held = {r["shard"]: bytes(r["filter"]) for r in filters.collect()}  # at most filter_bytes_most
        wrong = counts.where(F.col("docs") < min_docs).select("k1", "k2").mapInArrow(wrongly_held(held, shards), KEY)
        wrong = [(r.k1, r.k2) for r in wrong.limit(EXCEPTIONS_MOST + 1).collect()]
        if len(wrong) <= EXCEPTIONS_MOST:
            shared = docs.sparkSession.sparkContext.broadcast((held, np.array(wrong, np.int64).reshape(-1, 2)))
            return rows.mapInArrow(cut_batches(Judge(shared, shards), min_chars, digest), schema)
    found = docs.select("doc_id", "text").mapInArrow(keyed_batches(min_chars), f"doc_id long, {KEY}").join(hot, ["k1", "k2"], "left_semi")
    found = found.groupBy(F.col("doc_id").alias(FOUND + "_id")).agg(F.collect_set(F.struct("k1", "k2")).alias(FOUND))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col(FOUND + "_id")), "left").drop(FOUND + "_id")
    return joined.mapInArrow(cut_batches(listed, min_chars, digest), schema)


class Judge:
    """Drops lines that the broadcast filters accept, except those listed as accepted wrongly."""

    def __init__(self, shared, shards: int):
        self.shared, self.shards, self.filters = shared, shards, None

    def __getstate__(self):
        return {"shared": self.shared, "shards": self.shards, "filters": None}

    def __call__(self, batch: pa.RecordBatch):
        held, wrong = self.shared.value
        if self.filters is None:
            self.filters = {k: CuckooFilter.read(v) for k, v in held.items()}

        def judge(row: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
            yes = accepted(self.filters, self.shards, k1, k2)
            if yes.any() and len(wrong):
                at = np.flatnonzero(yes)
                known = {tuple(x) for x in wrong[np.isin(wrong[:, 0], k1[at])].tolist()}
                yes[at] = [(a, b) not in known for a, b in zip(k1[at].tolist(), k2[at].tolist())]
            return yes

        return judge


def keyed_batches(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in split_rows(batch):
                k1, k2, long = line_keys([normal(x) for lines in rows for x in lines], min_chars)
                row = first + np.repeat(np.arange(len(rows)), [len(x) for x in rows])
                ids = batch.column("doc_id").take(pa.array(row[long]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(k1[long]), pa.array(k2[long])], names=["doc_id", "k1", "k2"])

    return run


def listed(batch: pa.RecordBatch):
    """Drops the lines whose keys the batch's column FOUND lists."""
    column = batch.column(FOUND)
    lists = column.to_pylist()
    tag = lambda row, k1, k2: mix(mix(row.astype(np.uint64)) + k1.view(np.uint64)) ^ k2.view(np.uint64)
    flat = [(i, x["k1"], x["k2"]) for i, xs in enumerate(lists) for x in xs or ()]
    known = tag(*(np.array(x, np.int64) for x in zip(*flat))) if flat else np.zeros(0, np.uint64)

    def judge(row: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        return np.isin(tag(row.astype(np.int64), k1, k2), known)

    return judge
