import heapq
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from driftglass.llm.mixing import apportion, mix_sources


def shares(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = budget * sum(sizes.values())
    while open_:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > most * sizes[s]}
        if not over:
            return target | part
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def corpus(sources=5, n=300):
    r = random.Random(sources)
    names = [f"s{i}" for i in range(sources)] + [None]
    rows = [(i, " ".join("w" * r.randrange(1, 4) for _ in range(r.randrange(0, 90))), r.choice(names[:1] * 3 + names)) for i in range(n)]
    return rows + [(n, None, "s0"), (n + 1, "", "s1"), (n + 2, "a\tb\nc  d\x0be", "empty ones"), (n + 2, "a\tb\nc  d\x0be", "empty ones"), (None, "x y", None), (n + 3, None, "nothing"), (n + 4, "word " * 5000, "s2")]


@pytest.mark.parametrize(("sources", "shard"), [(5, 4_000_000), (5, 1000), (1, 700), (40, 2000)])
def test_targets_and_bounds(spark, sources, shard):
    rows = corpus(sources)
    docs = spark.createDataFrame([(*x, 3) for x in rows], "doc_id long, text string, source string, taken int")
    run = lambda: mix_sources(docs, block_words=16, shard_words=shard)
    got = run().collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, run().collect()), key=str)
    source = {i: s for i, _, s in rows}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    of = defaultdict(int)
    for i, _, s in rows:
        of[s] += size[i]
    want = shares(of)
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == of[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
    for s, t in want.items():
        n_shards = -(-(of[s] + 1) // shard)
        assert abs(taken[s] - t) <= 16 * (1 + n_shards), (s, taken[s], t)


def test_apportion_is_highest_quotients(spark):
    for seed in range(6):
        r = random.Random(seed)
        votes = [r.choice([0, 1, r.randrange(1, 50), r.randrange(1, 5000)]) for _ in range(30)]
        seats = r.randrange(0, 400)
        df = apportion(spark.createDataFrame(list(enumerate(map(float, votes))), "sid int, v double"), [], "v", F.lit(seats).cast("long"), "got", ["sid"])
        got = {x.sid: x.got for x in df.collect()}
        heap = [(-v, i, 0) for i, v in enumerate(votes) if v]
        heapq.heapify(heap)
        want = dict.fromkeys(range(30), 0)
        for _ in range(seats if heap else 0):
            _, i, j = heapq.heappop(heap)
            want[i] += 1
            heapq.heappush(heap, (-votes[i] / (2 * j + 3), i, j + 1))
        assert got == want


def test_no_rows_and_no_words(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    rows = mix_sources(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
