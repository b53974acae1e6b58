import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftglass.llm import line_dedup as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(rows, min_docs, min_chars=1):
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        have = (t or "").split("\n")
        kept = [x for x in have if len(key(x)) < min_chars or seen[key(x)] < min_docs]
        out.append((i, len(have), len(have) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(5)
    common = ["Buy now", "  buy NOW\t", "é È", "x", "", " \r", "copyright", "Ångström"]
    rows = [(i, "\n".join(r.choice([*common, f"line {r.randrange(60)}"]) for _ in range(r.randrange(0, 9)))) for i in range(60)]
    return rows + [(90, None), (91, ""), (92, "\n\n"), (92, "buy now\n"), (None, "Buy Now"), (93, "buy now\n" * 3000), rows[0]]


@pytest.mark.parametrize(("most", "min_docs", "min_chars", "batches"), [(L.FILTER_BYTES_MOST, 10, 1, 2), (0, 10, 1, 1), (L.FILTER_BYTES_MOST, 3, 4, 3)])
def test_matches_brute_force(spark, most, min_docs, min_chars, batches):
    docs = spark.createDataFrame([(i, t, 1) for i, t in corpus()], "doc_id long, text string, kept int")
    got = L.line_dedup(docs, min_docs, min_chars, most, digest=True, batches=batches)
    assert sorted(map(tuple, got.collect()), key=str) == brute(corpus(), min_docs, min_chars)


def test_empty_table(spark):
    assert L.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keeps_other_columns(spark):
    docs = spark.createDataFrame([(i, f"same\nown {i}", i + 1, "f") for i in range(12)] + [(12, None, 13, "f")], "doc_id long, text string, found int, k1 string")
    got = L.line_dedup(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(i, f"own {i}", i + 1, "f") for i in range(12)] + [(12, "", 13, "f")]


def test_counts_and_filters_are_reversible(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first, rest = docs.where("doc_id < 30"), docs.where("NOT coalesce(doc_id < 30, false)")
    a, b = L.line_counts(first), L.line_counts(rest)
    both = L.updated_counts(a, added=b)
    as_set = lambda df: {tuple(r) for r in df.select("k1", "k2", "docs").collect()}
    assert as_set(both) == as_set(L.line_counts(docs))
    assert as_set(L.updated_counts(both, deleted=b)) == as_set(a)
    hot = lambda df: df.where(F.col("docs") >= 4)
    filters = L.build_filters(hot(a), 3)
    grown = L.updated_filters(filters, a, both, 3, 4)
    shrunk = L.updated_filters(grown, both, a, 3, 4)
    for counts, made in ((both, grown), (a, shrunk)):
        held = {r["shard"]: L.CuckooFilter.read(bytes(r["filter"])) for r in made.collect()}
        rows = counts.collect()
        k1, k2 = (np.array([r[c] for r in rows], np.int64) for c in ("k1", "k2"))
        assert (L.accepted(held, 3, k1, k2) == np.array([r.docs >= 4 for r in rows])).all()


def test_cuckoo_filter_grows_and_forgets():
    r = np.random.default_rng(1)
    k1, k2 = r.integers(-(2**63), 2**63, (2, 5000))
    made = L.CuckooFilter.of(k1, k2)
    assert made.holds(k1, k2).all()
    made.delete(k1[:2500], k2[:2500])
    assert made.holds(k1[2500:], k2[2500:]).all() and made.holds(k1[:2500], k2[:2500]).mean() < 0.01


def test_lines_that_break_polynomial_hashes(spark):
    """A Thue-Morse line and its complement have one polynomial hash modulo 2**64, whatever base and values."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << 11))
    rows = [(i, f"{word if i % 2 else word.translate(str.maketrans('ab', 'ba'))}\nown {i}") for i in range(18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(x[0], x[2]) for x in sorted(map(tuple, L.line_dedup(docs, digest=True).collect()))] == [(i, 0) for i in range(18)]
