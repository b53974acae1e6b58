"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

* Codes: vectors are centred, projected on their principal axes, and turned by rotations learned (iterative quantisation)
  so that signs lose little; each rotation gives one bit for each axis. Learned from at most SAMPLE vectors.
* Index: a code is cut into substrings of 8 bits. For each substring, vectors lie sorted by its value.
* Search within Hamming radius r, by pigeonhole: with m substrings and r = m a + b, a code within r is within a of the query
  in one of the first b + 1 substrings, or within a - 1 in one of the others. Every such bucket is probed, so no code within
  the radius is missed; codes outside it are dropped by a bit count, and the rest is ranked on the original vectors.
* Radius: a first small one finds a preliminary k-th neighbour; the final one is the Hamming distance that MARGIN of true
  neighbours at that angle stay below (measured on the sample). With fewer than k found, the radius covers everything.

Scale: the index is dealt out into shards of about shard_rows vectors and the queries into blocks of about block_queries;
a task searches one block in one shard, and gives k rows for each query. Nothing is gathered but the sample.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose length differs
from the most frequent one (of equally frequent ones the longer); null vec_ids take no part; rows that share a vec_id are
all candidates, but not for a query of that id, which is asked once, with the smallest of their vectors; equal vectors rank
by vec_id; with fewer than k candidates all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftglass.llm.storage import stored

SAMPLE, ROTATIONS, STEPS, MARGIN, FIRST_SHARE = 4000, 4, 40, 0.9, 0.005
# substring values within 0, 1, ... 8 bits of zero
NEAR = [np.array([sum(1 << i for i in c) for n in range(d + 1) for c in combinations(range(8), n)], np.int64) for d in range(9)]


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v of the rows that take part; lengths aren't checked."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def learn(x: np.ndarray, rotations: int = ROTATIONS, seed: int = 11) -> dict:
    """The centre and projections of codes, and the excess of true neighbours' Hamming share over their angle."""
    r = np.random.default_rng(seed)
    centre = x.mean(axis=0)
    axes = np.linalg.eigh(np.atleast_2d(np.cov((x - centre).T, bias=True)))[1]
    p = (x - centre) @ axes
    maps = []
    for _ in range(rotations):
        turn = np.linalg.qr(r.normal(size=(x.shape[1], x.shape[1])))[0]
        for _ in range(STEPS):
            u, _, v = np.linalg.svd(np.sign(p @ turn).T @ p)
            turn = (u @ v).T
        maps.append(axes @ turn)
    width = -(-x.shape[1] * rotations // 8) * 8
    turned = np.zeros((x.shape[1], width))
    turned[:, : x.shape[1] * rotations] = np.hstack(maps)
    model = {"centre": centre, "maps": turned, "excess": 0.5}
    n = min(len(x), 300)
    if len(x) > 20:
        code, angle_of = encode(model, x), unit(x - centre)
        d = ((x[:n, None] - x[None]) ** 2).sum(axis=2) if len(x) * n * x.shape[1] < 1 << 22 else np.maximum(0, (x[:n] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x[:n] @ x.T)
        d[np.arange(n), np.arange(n)] = np.inf
        near = np.argpartition(d, 10, axis=1)[:, :10]
        ham = np.bitwise_count(code[:n, None] ^ code[near]).sum(axis=2)
        angle = np.arccos(np.einsum("ij,ikj->ik", angle_of[:n], angle_of[near]).clip(-1, 1))
        model["excess"] = float(np.quantile(ham / width - angle / np.pi, MARGIN))
    return model


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def encode(model: dict, x: np.ndarray) -> np.ndarray:
    """Codes as rows of bytes; each byte is a substring."""
    return np.packbits((x - model["centre"]) @ model["maps"] > 0, axis=1)


class Shard:
    """A multi-index over some vectors."""

    def __init__(self, model: dict, ids: np.ndarray, x: np.ndarray):
        self.model, self.ids, self.x = model, ids, x
        self.code = encode(model, x)
        self.turned = unit(x - model["centre"])
        self.order = [np.argsort(self.code[:, j], kind="stable") for j in range(self.code.shape[1])]
        self.edges = [np.searchsorted(self.code[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of all vectors whose codes lie within the radius."""
        m = len(code)
        if radius >= 8 * m:
            return np.arange(len(self.ids))
        a, b = divmod(radius, m)
        seen = np.zeros(len(self.ids), bool)
        for j in range(m):
            most = a if j <= b else a - 1
            if most < 0:
                continue
            values = NEAR[min(most, 8)] ^ int(code[j])
            lo, hi = self.edges[j][values], self.edges[j][values + 1]
            many = hi - lo
            at = np.arange(many.sum()) + np.repeat(lo - np.cumsum(many) + many, many)
            seen[self.order[j][at]] = True
        at = np.flatnonzero(seen)
        return at[np.bitwise_count(self.code[at] ^ code).sum(axis=1) <= radius]

    def nearest(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the k nearest found, ties to smaller ids."""
        code = encode(self.model, q[None])[0]
        bits, turned = 8 * len(code), unit(q - self.model["centre"])
        wanted = max(4 * k, int(FIRST_SHARE * len(self.ids)))
        radius = bits // 8
        while True:
            at = self.within(code, radius)
            at = at[self.ids[at] != query_id]
            if len(at) >= min(wanted, len(self.ids)) or radius >= bits:
                break
            radius += max(1, bits // 32)
        best, dist = self.rank(at, q, k)
        if len(best) == k and radius < bits:
            angle = np.arccos((self.turned[best] @ turned).clip(-1, 1)).max()
            final = int(np.ceil(bits * (angle / np.pi + self.model["excess"])))
            if final > radius:
                at = self.within(code, min(bits, final))
                best, dist = self.rank(at[self.ids[at] != query_id], q, k)
        return best, dist

    def rank(self, at: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        dist = np.sqrt(((self.x[at] - q) ** 2).sum(axis=1))
        if len(at) > 4 * k:
            some = np.flatnonzero(dist <= np.partition(dist, k)[k])
            at, dist = at[some], dist[some]
        order = np.lexsort((self.ids[at], dist))[:k]
        return at[order], dist[order]


FOUND = "query_id long, vec_id long, score double"


def search_cells(shared, k: int):
    def run(key, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(index) and len(queries):
            shard = Shard(shared.value, index.vec_id.to_numpy(np.int64), np.stack(index.v.to_numpy()).astype(np.float64))
            for query_id, q in zip(queries.query_id, queries.q):
                at, dist = shard.nearest(query_id, np.asarray(q, np.float64), k)
                out.append((np.full(len(at), query_id), shard.ids[at], dist))
        ids, found, dist = (np.concatenate(x) for x in zip(*out)) if out else ((), (), ())
        return pd.DataFrame({"query_id": np.asarray(ids, np.int64), "vec_id": np.asarray(found, np.int64), "score": np.asarray(dist, np.float64)})

    return run


def nearest_neighbours(
    vectors: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, shard_rows: int = 16384, block_queries: int = 4096
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors where `queries` holds, the k nearest others found."""
    flagged = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), queries.alias("asked"))
    rows = usable(flagged, "vec_id", "embedding")
    sizes = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    spark = vectors.sparkSession
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n = sizes["dims"], sizes["count"]
    rows = rows.where(F.size("v") == dims)
    chosen = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < max(1, int(1_000_000 * min(1, sample / n)))).limit(2 * sample)
    x = chosen.orderBy("vec_id").select("v").toArrow().column("v").combine_chunks()
    x = x.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    model = learn(x if len(x) > 1 else np.vstack([np.eye(dims), -np.eye(dims)]))
    shared = spark.sparkContext.broadcast(model)  # the size of the rotations

    ids = flagged.where(F.col("asked")).select("vec_id").distinct()
    asked = rows.join(ids, "vec_id", "left_semi").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    asked = stored(asked, "queries")
    shards, blocks = -(-n // shard_rows), max(1, -(-asked.count() // block_queries))
    index = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    cells = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
    found = cells.applyInPandas(search_cells(shared, k), FOUND)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
