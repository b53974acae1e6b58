import random

import numpy as np

from driftglass.llm import language_id as L

SOUNDS = {"aa": ("ka", "lo", "mi", "ta", "ru"), "bb": ("sch", "en", "der", "ung", "ei"), "cc": ("é", "eau", "ou", "qu", "tion")}


def text(r, lang, n):
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def corpus(n=400, seed=1):
    r = random.Random(seed)
    return [(i, text(r, lang, r.randrange(3, 200)), lang) for i in range(n) for lang in [r.choice(list(SOUNDS))]]


def test_held_out_accuracy_and_rejection(spark):
    rows = corpus()
    odd = [(1000, None, "aa"), (1001, "12 %% ##", "bb"), (1002, "", None), (1003, "ka lo mi " * 50_000, None), (1004, "0x1F zz9 qzx wvw jjj xzq " * 9, None)]
    docs = spark.createDataFrame([(*x, 0.5) for x in rows + odd], "doc_id long, text string, lang string, score double")
    held = L.held_out()
    model = L.fit(docs.where(~held))
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    assert len(got) == len(rows) + len(odd)
    ids = {r.doc_id for r in docs.where(held).collect() if r.doc_id < 1000}
    right = [got[i].lang_pred == lang for i, _, lang in rows if i in ids]
    assert len(right) > 50 and sum(right) / len(right) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {(got[i].lang_pred, got[i].score, got[i].rejected) for i in (1000, 1001, 1002)} == {("und", 0.0, True)}
    assert got[1003].lang_pred == "aa" and not got[1003].rejected
    kept = L.accepted(docs, model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {i for i, r in got.items() if not r.rejected} and len(ids) > 0.97 * len(rows)


def test_chunks_do_not_matter(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(120, 2), "doc_id long, text string, lang string")
    model = L.fit(docs)
    whole = sorted(map(tuple, L.identify(docs, model).collect()))
    batch = docs.toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(L, "CHUNK", 37)

    class Shared:
        value = model

    got = sorted(tuple(r.values()) for b in L.predict_batches(Shared)([batch]) for r in b.to_pylist())
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in whole]
    assert max(abs(x[2] - y[2]) for x, y in zip(got, whole)) < 1e-5


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.fit(none) is None and L.identify(none, None).count() == 0
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert tuple(L.identify(docs, L.fit(docs)).first()) == (1, "und", 0.0, True)


def test_no_language_is_left_out(spark):
    rows = [(i, text(random.Random(i), "aa", 30), "aa") for i in range(300)] + [(1000 + i, f"xq{i}zv " * 20, f"l{i:03}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.lang for r in L.training_sample(docs, 100).select("lang").distinct().collect()}
    assert found == {"aa"} | {f"l{i:03}" for i in range(300)}


def test_scores_match_a_plain_scorer(spark):
    """The whole query, text by text: n-grams within words, their rows of the table, the softmax of their mean."""
    rows = corpus(60, 5) + [(60, "Ka-lo mi", None), (60, "tion qu'eau É", None), (None, "12 ung", None), (61, None, None), (62, "%% 7", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)

    def plain(t):
        raw = (t or "").encode()
        data = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in raw)
        total, n = np.zeros(len(model["langs"])), 0
        for i in range(len(data)):
            for k in range(1, 5):
                g = data[i : i + k]
                if len(g) == k and any(g) and all(g[1:-1]):
                    h = ((int.from_bytes(g, "little") ^ (0x9E3779B9 * k & 0xFFFFFFFF)) * 0x85EBCA6B) & 0xFFFFFFFF
                    h ^= h >> 13
                    total += model["table"][((h * 0xC2B2AE35) & 0xFFFFFFFF) >> 18]
                    n += 1
        if not any(c.isalpha() for c in t or ""):
            return "und", 0.0
        z = np.exp(total / max(1, n) + model["bias"])
        return model["langs"][int(z.argmax())], float(z.max() / z.sum())

    got = sorted(((r.lang_pred, r.score) for r in L.identify(docs, model).collect()), key=str)
    want = sorted((plain(t) for _, t, _ in rows), key=str)
    assert [x[0] for x in sorted(got)] == [x[0] for x in sorted(want)]
    assert np.allclose(sorted(x[1] for x in got), sorted(x[1] for x in want), atol=1e-4)
