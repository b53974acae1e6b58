import hashlib
import random

import numpy as np
import pytest

from driftglass.llm import edit_prints as E


def walk(text):
    """The embedding, a character at a time."""
    out, c = {}, E.classes(text)
    for s in range(-(-len(c) // E.STRETCH)):
        own = c[s * E.STRETCH : (s + 1) * E.STRETCH]
        i = 0
        for j in range(E.STEPS):
            if i == len(own):
                break
            out[s * E.STEPS + j] = own[i]
            i += int(E.ADVANCE[j, own[i]])
    return out


def brute(text):
    w = walk(text)
    last = max(w, default=-1)
    return "".join("0123456789abcdef"[E.DIGIT[w[int(p)]] if int(p) in w else 0] for p in E.PLACES[E.PLACES <= last]).rstrip("0")


def share(p, q):
    if not p and not q:
        return 1.0
    n = max(len(p), len(q))
    p, q = p.ljust(n, "0"), q.ljust(n, "0")
    some = [(a, b, w) for a, b, w in zip(p, q, E.WEIGHTS) if (a, b) != ("0", "0")]
    return sum(w for a, b, w in some if a == b) / sum(w for *_, w in some)


def prose(r, n):
    return " ".join("".join(r.choice("etaoinshrdlé😀") for _ in range(r.randrange(2, 9))) for _ in range(n))


def corpus(seed):
    r = random.Random(seed)
    rows = [(i * 3, prose(r, r.choice([1, 5, 40, 300, 900]))) for i in range(30)]
    rows += [(200, rows[4][1]), (201, rows[4][1]), (202, ""), (203, None), (5, "x"), (5, "y"), (5, "y"), (None, "none"), (None, ""), (204, "z" * 9000)]
    r.shuffle(rows)
    return rows


def expected(rows):
    """Rows in an order that the results fix for doc_ids that repeat."""
    out = []
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        cut = len(t) // 3
        new = t[: len(t) - cut] + following[:cut]
        p, q = brute(t), brute(new)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), p, q, share(p, q), share(p, brute(following))))
    return out


@pytest.mark.parametrize(("seed", "ranges"), [(1, 1), (2, 4), (3, 50)])
def test_matches_brute_force(spark, seed, ranges):
    rows = [(i, t) for i, t in corpus(seed) if i not in (5, None)] + [(5, "y"), (5, "y"), (None, "end")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, last int, range string").repartition(3)
    got = E.edit_fingerprints(docs, ranges).collect()
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0)))
    key = lambda x: (x[0] is None, x[0] or 0, x[2:5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(expected(ordered), key=key), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:])


def test_ids_that_repeat_and_empty_tables(spark):
    docs = spark.createDataFrame(corpus(4), "doc_id long, text string").repartition(3)
    got, again = ({(r.doc_id, r.fingerprint, r.edited_sha256) for r in E.edit_fingerprints(docs, k).collect()} for k in (2, 9))
    assert got == again and E.edit_fingerprints(docs, 3).count() == len(corpus(4))
    schema = "doc_id long, text string"
    assert E.edit_fingerprints(spark.createDataFrame([], schema)).count() == 0
    one = E.edit_fingerprints(spark.createDataFrame([(7, "abcdef")], schema)).collect()
    assert [(r.n_chars, r.edited_sha256, r.near_next) for r in one] == [(6, hashlib.sha256(b"abcdab").hexdigest(), 1.0)]


def test_few_edits_leave_texts_alike(spark):
    r = random.Random(5)
    for n in (60, 600, 4000):
        text, other = prose(r, n), prose(r, n)
        near = list(text)
        for _ in range(max(1, len(text) // 1000)):
            k = r.randrange(len(near))
            near[k : k + r.randrange(2)] = r.choice(["", "q", "qq"])
        a, b, c = E.fingerprints([text, "".join(near), other])
        assert E.likeness(a, b) > 0.75 > 0.4 > E.likeness(a, c)
        assert abs(E.likeness(a, E.fingerprints([E.edited(text, other)])[0]) - 0.7) < 0.12


def test_texts_are_linked_by_bands(spark):
    r = random.Random(6)
    rows, group = [], {}
    for g in range(12):
        text = prose(r, r.choice([80, 200, 500]))
        for k in range(5):
            t = list(text)
            if k > 1:
                t[r.randrange(len(t))] = "#"
            rows.append((len(rows) * 7 % 61 + 1, "".join(t)))
            group[rows[-1][0]] = g
    rows += [(100, ""), (101, None), (102, ""), (None, rows[0][1]), (103, "lone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    prints = E.text_fingerprints(docs)
    digits = {x.doc_id: E.valued(x.fingerprint) for x in prints.collect()}
    ids = sorted(group)
    parent = {i: i for i in ids}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in ids:
        for j in ids:
            if i < j and E.likeness(digits[i], digits[j]) >= 0.75:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = {i: root(i) for i in ids} | {k: k for k in (100, 101, 102, 103)} | {None: None}
    for block in (E.BLOCK, 3):
        got = {x.doc_id: x.class_id for x in E.linked(prints, block=block).collect()}
        assert got == want
    assert len({want[i] for i in ids}) < 20
