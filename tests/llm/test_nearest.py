import math

import numpy as np
from pyspark.sql import functions as F

from driftglass.llm.nearest import NEAR, Shard, learn, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, rank int, query_id string"


def brute(rows, k=10):
    ok = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = {}
    for i, q in ok:
        if i % 10 == 0:
            near = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in ok if j != i)[:k]
            out[i] = near
    return out


def ask(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    out = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 10 == 0, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_on_random_and_clustered_vectors(spark):
    r = np.random.default_rng(4)
    spots = r.normal(size=(20, 32))
    x = np.vstack([r.normal(size=(1000, 32)), spots[r.integers(0, 20, 1000)] + 0.3 * r.normal(size=(1000, 32))])
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got, want = ask(spark, rows, shard_rows=500, block_queries=64), brute(rows)
    assert got.keys() == want.keys()
    found = [len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want]
    assert sum(found) / (10 * len(want)) >= 0.97
    exact = dict(rows)
    assert all(abs(s - np.linalg.norm(np.subtract(exact[q], exact[j], dtype=np.float64))) < 1e-9 for q in got for s, j in got[q])


def test_odd_vectors_ties_and_small_tables(spark):
    rows = [(i, [1.0, 2.0]) for i in range(15)] + [(20, None), (30, []), (40, [0.0, 0.0]), (50, [1.0, None]), (60, [float("nan"), 1.0]), (70, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    got = ask(spark, rows)
    assert got == {0: [(0.0, i) for i in range(1, 11)], 10: [(0.0, i) for i in range(10)]}
    assert ask(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0])]) == {0: [(math.sqrt(2), 1)]}
    assert ask(spark, [(0, [1.0, 0.0])]) == {} and ask(spark, []) == {}


def test_every_code_within_the_radius_is_found():
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 24))
    shard = Shard(learn(x), np.arange(400), x)
    for radius in (0, 3, 7, 11, 20, 33, 60):
        far = np.bitwise_count(shard.code ^ shard.code[7]).sum(axis=1)
        assert shard.within(shard.code[7], radius).tolist() == np.flatnonzero(far <= radius).tolist()
    assert [len(x) for x in NEAR] == [1, 9, 37, 93, 163, 219, 247, 255, 256]
