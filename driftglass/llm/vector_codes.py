"""Product quantisation of vectors on whole numbers, with nearest entries found by partial distances.

A component x becomes floor(4096 x); a vector is cut in PARTS equal consecutive parts (the last are shorter, or empty, where
the length isn't a multiple), and each part position has a codebook of ENTRIES entries. It starts as the parts of the first
kept rows by vec_id; each of ROUNDS rounds assigns every part to its nearest entry and moves every entry to the floor of the
mean of its parts.

Partial distances: a part's dimensions are taken in descending variance of the codebook. All vectors of a batch carry the
least complete distance known so far, at first that of a guess made on the two widest dimensions. Entries come one by one;
after each dimension a mask drops the vectors whose sum already strictly exceeds their least. What survives all
dimensions is a complete distance; on a tie the lower index stays. So the result is that of a full search, for less work.

Scale: vectors are read once a round and never shuffled. A task sends ENTRIES x length sums and the counts, which Spark adds
up; the codebooks (ENTRIES x length numbers, whatever the table) are all that the driver holds. Label totals are joined, by
broadcast if there are few labels.

Cases: rows go whose vector is null, or holds a null, NaN or infinite component, or differs in length from the first kept
row's (the usual length by contract). Fewer rows than ENTRIES give as many entries. Rows with one vec_id are rows of their
own, in order of their vectors, then of labels; a null vec_id comes after all others. Components are held within 2**62 steps; numbers that
might not fit 64 bits are worked out as Python's whole numbers, and an error that doesn't fit a long is null, as is its
label's. Vectors without components get code 0 in each part. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass.llm.storage import broadcast_if_small, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BATCH, HELD, LONG = 8192, 1 << 62, (1 << 63) - 1


def kept(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with a whole vector of finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(vector).isNotNull() & ~bad)


def steps(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as longs, within HELD."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x.astype(np.float64) * SCALE), -HELD, HELD).astype(np.int64)


def bounds(length: int, parts: int) -> list[tuple[int, int]]:
    width = -(-length // parts)
    return [(min(p * width, length), min((p + 1) * width, length)) for p in range(parts)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row of x its nearest row of book, ties to the lower index, and the squared distance."""
    n, width = x.shape
    reach = max((int(abs(a).max()) for a in (x, book) if a.size), default=0)
    if 4 * reach * reach * max(1, width) > LONG:
        x, book = x.astype(object), book.astype(object)
    order = np.argsort(-book.astype(float).var(axis=0), kind="stable")
    columns = [np.ascontiguousarray(x[:, d]) for d in order]

    def complete(index: np.ndarray) -> np.ndarray:
        return sum(((c - book[index, d]) ** 2 for c, d in zip(columns, order)), np.zeros(n, x.dtype))

    widest = sum(((columns[i][:, None] - book[None, :, order[i]]).astype(float) ** 2 for i in range(min(2, width))), np.zeros((n, len(book))))
    index = widest.argmin(axis=1)
    least = complete(index)
    for e in range(len(book)):
        rows, far = np.arange(n), np.zeros(n, x.dtype)
        for c, d in zip(columns, order):
            far = far + (c[rows] - book[e, d]) ** 2
            near = np.asarray(far <= least[rows], bool)
            rows, far = rows[near], far[near]
            if not len(rows):
                break
        better = np.asarray(far < least[rows], bool) | (index[rows] > e)
        index[rows[better]], least[rows[better]] = e, far[better]
    return index, least


def assigned(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a row a vector, a column a part) and squared distances of all parts."""
    found = [nearest(x[:, a:b], book) for (a, b), book in zip(bounds(x.shape[1], len(books)), books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1].astype(object) for f in found], axis=1)


def blocks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and vectors of pieces of a batch."""
    for first in range(0, len(batch), BATCH):
        column = batch.column("vector").slice(first, BATCH)
        yield first, steps(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length))


def sum_batches(books: list[np.ndarray], length: int):
    """For each part, entry and position: the sum and count of what is assigned, over a whole task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = len(books[0])
        sums, counts = np.zeros((entries, length), object), np.zeros((entries, len(books)), np.int64)
        for batch in batches:
            for _, x in blocks(batch, length):
                codes, _ = assigned(x, books)
                wide = x if int(abs(x).max(initial=0)) * len(x) < LONG else x.astype(object)
                for p, (a, b) in enumerate(bounds(length, len(books))):
                    for e in range(entries):
                        mine = codes[:, p] == e
                        counts[e, p] += int(mine.sum())
                        sums[e, a:b] += wide[mine, a:b].sum(axis=0)
        out = [(p, e, i, int(counts[e, p]), str(int(sums[e, i]))) for p, (a, b) in enumerate(bounds(length, len(books))) for e in range(entries) if counts[e, p] for i in range(a, b)]
        names = ["part", "entry", "place", "n", "total"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    return run


def moved(rows: DataFrame, books: list[np.ndarray], length: int) -> list[np.ndarray]:
    """The codebooks after one round over rows(vector)."""
    total = rows.select("vector").mapInArrow(sum_batches(books, length), "part int, entry int, place int, n long, total string")
    total = total.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = [b.copy() for b in books]
    starts = [a for a, _ in bounds(length, len(books))]
    for r in total.collect():  # ENTRIES x length at most
        out[r.part][r.entry, r.place - starts[r.part]] = int(r.total) // r.n
    return out


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vector: str = "embedding", key: str = "vec_id") -> list[np.ndarray]:
    """Codebooks, one for each part: arrays of entries x width. Without any row: none."""
    rows = kept(rows, vector)
    some = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    top = lambda: some.orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).collect()
    first = top()
    if not first:
        return []
    length = len(first[0].vector)
    some = some.where(F.size("vector") == length)
    if any(len(r.vector) != length for r in first):
        first = top()
    x = steps(np.array([r.vector for r in first], float).reshape(len(first), length))
    books = [x[:, a:b] for a, b in bounds(length, parts)]
    for _ in range(rounds if length else 0):
        books = moved(some, books, length)
    return books


def encode_batches(books: list[np.ndarray], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in blocks(batch, length):
                codes, far = assigned(x, books)
                total = far.sum(axis=1) if len(far) else []
                edges = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * len(books))
                column = pa.ListArray.from_arrays(edges, pa.array(codes.astype(np.int32).ravel()))
                error = pa.array([int(t) if t <= LONG else None for t in total], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, len(x)), batch.column("label").slice(first, len(x)), column, error], names=["key", "label", "codes", "error"])

    return run


def encode(rows: DataFrame, books: list[np.ndarray], vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """key, label, codes (an entry's number for each part) and error (squared distance, in steps) of the rows that can be coded."""
    kind = dict(rows.dtypes)
    schema = f"key {kind[key]}, label {kind[label]}, codes array<int>, error long"
    length = sum(b.shape[1] for b in books)
    some = kept(rows, vector).select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    some = some.where(F.size("vector") == length) if books else some.limit(0)
    return some.mapInArrow(encode_batches(books, length), schema).withColumnsRenamed({"key": key, "label": label})


def decode(codes: DataFrame, books: list[np.ndarray], column: str = "codes") -> DataFrame:
    """Adds approx: the vector that the codes stand for."""
    if not books:
        return codes.withColumn("approx", F.lit(None).cast("array<double>"))
    held = F.array(*(F.array(*(F.lit((e / SCALE).tolist()) for e in b)) for b in books))
    parts = F.transform(F.col(column), lambda c, p: F.element_at(F.element_at(held, p + 1), c + 1))
    return codes.withColumn("approx", F.flatten(parts))


def by_label(coded: DataFrame, label: str = "label") -> DataFrame:
    """Adds label_error: the error summed over equal labels, nulls together."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    fits = (F.count("error") == F.count("*")) & (total <= LONG)
    totals = stored(coded.groupBy(F.col(label).alias("_of")).agg(F.when(fits, total).cast("long").alias("label_error")), "labels")
    return coded.join(broadcast_if_small(totals), F.col(label).eqNullSafe(F.col("_of"))).drop("_of")


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers with commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def hex_codes(column: str = "codes"):
    """Codes as one string, two hexadecimal digits each."""
    return F.lower(F.array_join(F.transform(column, lambda c: F.lpad(F.hex(c), 2, "0")), ""))
