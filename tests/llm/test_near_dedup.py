import random
import re

import numpy as np

from driftglass.llm import near_dedup as N


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            if sets[i] and sets[j] and (100 * k >= 75 * len(sets[i] | sets[j]) or same_id):
                parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None] if sets[i] else [d]
        least = min((x for x in ids if x is not None), default=None)
        out.append((d, len(sets[i]), least, d is not None and d == least))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(4))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(r.randrange(5, 120))]
        for _ in range(r.randrange(1, 14)):
            copy = list(base)
            for _ in range(r.randrange(0, 1 + len(base) // 18)):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += [rows[0], rows[0].upper().replace("É", "é"), rows[5] + "\n\t", "one two", "One  TWO ", "one", "", " \n", None, "x " * 30_000]
    r.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*x, 1, "z") for x in rows], "doc_id long, text string, node int, key string")
    return sorted(map(tuple, N.near_duplicates(docs, **options).collect()), key=str)


def test_matches_brute_force(spark):
    rows = corpus(1)
    got = run(spark, rows)
    assert got == brute(rows) and 5 < sum(x[3] for x in got) < len(rows) - 15


def test_small_blocks_nulls_and_repeats(spark):
    rows = corpus(2)[:60]
    rows += [(None, rows[0][1]), (None, "only without an id and its own words"), (None, "only without an id and its own words"), rows[3], (None, None)]
    assert run(spark, rows, block=3) == brute(rows)


def test_texts_of_one_id_keep_their_links(spark):
    r = random.Random(8)
    text = lambda: [f"w{r.randrange(999)}" for _ in range(60)]
    x, y, z, u = (text() for _ in range(4))
    near = lambda t, k: [*t[:k], "other", *t[k + 1 :]]
    rows = [(1, x), (1, y), (3, near(x, 30)), (4, near(y, 20)), (2, z), (6, z), (6, u), (7, near(u, 9)), (8, u), (9, text()), (None, near(z, 3)), (9, ["a"]), (None, x)]
    rows = [(i, " ".join(t)) for i, t in rows]
    got = run(spark, rows)
    assert got == brute(rows)
    assert {x[0]: x[2] for x in got} == {1: 1, 3: 1, 4: 1, 2: 2, 6: 2, 7: 2, 8: 2, 9: 9, None: 2} or {x[2] for x in got if x[0] is None} == {1, 2}


def test_empty_table(spark):
    assert run(spark, []) == []


def test_estimate_follows_similarity():
    r = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        common = r.integers(0, 2**63, int(4000 * share), dtype=np.uint64) * np.uint64(2)
        rest = (4000 - len(common)) // 2
        sets = [np.unique(np.append(common, r.integers(0, 2**63, rest, dtype=np.uint64))) for _ in range(2)]
        m = N.minima(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
        got = N.estimate(*N.packed(m)[:, None])[0]
        assert abs(got - share) < 0.15


def test_words_that_break_polynomial_hashes(spark):
    """Thue-Morse words and their complements have one polynomial hash modulo 2**64; their texts share no shingle."""
    say = lambda n, flip: "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))
    rows = [(flip, " ".join(say(1 << 11, flip) for _ in range(9))) for flip in (0, 1)]
    assert run(spark, rows) == [(0, 1, 0, True), (1, 1, 1, True)]


def test_long_texts_are_cut_between_words():
    from driftglass.llm import buffers as B

    text = ("añb cd\x0bE " * 9 + "x" * 50 + "  ").encode()
    data, known = np.frombuffer(text, np.uint8), B.WordHashes()
    whole = np.concatenate(list(B.text_hashes(data, known)))
    for size in (1, 2, 7, 64):
        B.PIECE, before = size, B.PIECE
        assert (np.concatenate(list(B.text_hashes(data, known))) == whole).all()
        B.PIECE = before
    assert len(whole) == 28
