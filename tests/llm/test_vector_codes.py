import hashlib
import math

import numpy as np
import pytest

from driftglass.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, key string, codes int"


def brute(rows, parts=8, entries=16, rounds=6):
    ok = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(4096 * float(np.float32(v))) for v in r[1]] for r in ok]
    w = len(x[0]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in x]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    near = lambda c: [min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)]
    for _ in range(rounds):
        found = [near(c) for c in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(z) // len(mine) for z in zip(*mine)]
    out = [(r[0], "".join(f"{k:02x}" for _, k in near(c)), sum(d for d, _ in near(c)), r[2]) for r, c in zip(ok, cut)]
    labels = {}
    for r in out:
        labels[r[3]] = labels.get(r[3], 0) + r[2]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((*r[:3], labels[r[3]]) for r in out), key=str), digest


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA).repartition(3)
    books = V.fit(df, **options)
    coded = V.by_label(V.encode(df, books)).withColumn("code", V.hex_codes())
    return sorted((tuple(r) for r in coded.select("vec_id", "code", "error", "label_error").collect()), key=str), V.books_digest(books)


@pytest.mark.parametrize(("n", "dims", "spread"), [(300, 16, 1.0), (9, 8, 1.0), (120, 24, 0.001), (60, 8, 1e6)])
def test_matches_brute_force(spark, n, dims, spread):
    r = np.random.default_rng(n)
    x = (r.normal(size=(n, dims)) * spread).round(3)
    x[: n // 3] = x[n // 2]  # a third are copies
    rows = [(int(i * 7 % n), v.astype(np.float32).tolist(), [0, 1, None][i % 3]) for i, v in enumerate(x)]
    rows += [(1, None, 0), (2, [1.0] * (dims - 1) + [None], 0), (3, [float("nan")] * dims, 1), (4, [float("inf")] * dims, 1), (None, [0.5] * dims, 1)]
    got, digest = run(spark, rows)
    want, known = brute(rows)
    assert digest == known
    fits = [(*w[:2], *(e if e < 2**63 else None for e in w[2:])) for w in want]
    assert got == fits if spread < 1e5 else [g[:3] for g in got] == [w[:3] for w in fits]


def test_odd_lengths_and_empty_tables(spark):
    assert run(spark, []) == ([], V.books_digest([]))
    got, _ = run(spark, [(1, [], 0), (2, [], 0), (3, [1.0], 0)])
    assert got == [(1, "00" * 8, 0, 0), (2, "00" * 8, 0, 0)]
    got, _ = run(spark, [(1, [1.0, 2.0, 3.0], 0), (2, [1.0, 2.0], 0), (3, [1.0, 2.0, 3.0], None)])
    assert got == [(1, "00" * 8, 0, 0), (3, "00" * 8, 0, 0)]


def test_codes_are_decoded(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(i, v.tolist(), 0, "k", 1) for i, v in enumerate(r.normal(size=(40, 16)).astype(np.float32))], SCHEMA)
    books = V.fit(df, rounds=1)
    for row in V.decode(V.encode(df, books), books).join(df.select("vec_id", "embedding"), "vec_id").collect():
        far = sum((math.floor(a * 4096) - round(b * 4096)) ** 2 for a, b in zip(row.embedding, row.approx))
        assert far == row.error


def test_partial_distances_are_those_of_a_full_search():
    r = np.random.default_rng(2)
    x, book = r.integers(-9, 9, (500, 5)), r.integers(-9, 9, (16, 5))
    book[7] = book[3]
    far = ((x[:, None] - book) ** 2).sum(axis=2)
    index, least = V.nearest(x, book)
    assert (index == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()
