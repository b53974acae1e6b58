import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from driftglass.llm import buffers as B
from driftglass.llm.suffix_dedup import SuffixIndex, suffix_dedup


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, length):
    r = random.Random(seed)
    say = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    passages = [say(n) for n in (length - 1, length, length + 1, 2 * length, 3 * length)]
    rows = [(i, say(r.randrange(0, 60)) + r.choice(passages) + say(r.randrange(0, 60)) + r.choice(passages)) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "ab" * length), (53, "x" * (3 * length)), (54, rows[0][1]), (54, rows[0][1]), (55, passages[4][: length + 40] + say(9)), (None, rows[1][1]), (None, say(90)), (54, say(70) + passages[3]), (54, say(90)), (None, None)]
    return rows


@pytest.mark.parametrize(("length", "group_most", "batches"), [(60, 20_000, 3), (60, 0, 4), (200, 3, 1)])
def test_matches_brute_force(spark, length, group_most, batches):
    rows = corpus(length + batches, length)
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, start string")
    got = suffix_dedup(docs, length, batches, group_most).drop("kept")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, length)


def test_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_levels_grow_and_an_index_can_be_opened_again(spark, tmp_path):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(7, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole, index = SuffixIndex(spark, 60), SuffixIndex(spark, 60)
    parts = [docs.where(f"doc_id % 5 = {i}") for i in range(5)]
    for i, part in enumerate(parts):
        whole.append(part)
        if i < 3:
            index.append(part)
    index.save(str(tmp_path / "manifest"))
    again = SuffixIndex.open(spark, str(tmp_path / "manifest"), 60)
    for part in parts[3:]:
        again.append(part)
    sizes = [n for n, _, _ in again.levels]
    assert all(a >= 1.5 * b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == sum(n for n, _, _ in whole.levels)
    found = [sorted(map(tuple, x.collect())) for index in (whole, again) for x in index.repeated()]
    assert found[0] == found[2] and found[1] == found[3] and found[0] and found[1]
    order = [tuple(r) for r in again.levels[0][1].select("head", "key", "reach").collect()]
    assert order == sorted(order)


def test_sound_hashes_do_not_collide_on_structured_strings():
    word = np.frombuffer(bytes(97 + bin(i).count("1") % 2 for i in range(1 << 12)), np.uint8)
    data = np.concatenate([word, 195 - word, word])
    sums, n = B.sound_sums(data), len(word)
    a, b, c = (B.sound_hash(sums, np.array([k * n]), np.array([k * n + n]))[0] for k in range(3))
    assert a != b and a == c
