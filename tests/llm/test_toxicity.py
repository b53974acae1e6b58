import math
import random

import numpy as np

from driftglass.llm import toxicity as T


def corpus(n=600, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abdeilmnorst") for _ in range(r.randrange(2, 8)))
    common, bad = [word() for _ in range(300)], ["zukvra", "groxpit", "vulkash"]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(common) for _ in range(r.randrange(5, 150))]
        toxic = r.random() < 0.3
        for _ in range(r.randrange(1, 4) if toxic else 0):
            words.insert(r.randrange(len(words) + 1), r.choice(bad))
        docs.append((i, " ".join(words).capitalize()))
        labels.append((i, int(toxic)))
    return docs, labels, bad


def test_held_out_scores_and_spans(spark):
    rows, marks, bad = corpus()
    odd = [(1000, None), (1001, ""), (1002, "123 !!"), (1003, "plain " * 100_000 + "groxpit")]
    docs = spark.createDataFrame([(*x, 1) for x in rows + odd], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(*x, 1) for x in marks[:400]] + [(None, 1, 0), (5, None, 0), marks[0] + (0,)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in T.score(docs, T.fit(docs, labels)).collect()}
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got.values())
    truth = dict(marks)
    right = [(got[i].score >= 0.7) == bool(truth[i]) for i in range(400, 600)]
    assert sum(right) / len(right) > 0.97
    texts = {i: t for i, t in rows}
    spans = [texts[i].encode()[s.start : s.end].decode().lower() for i in range(400, 600) for s in got[i].spans]
    assert spans and sum(set(s.split()) <= set(bad) for s in spans) / len(spans) > 0.95
    assert got[1003].score > 0.5 and got[1000].spans == got[1001].spans == got[1002].spans == [] and got[1001].score < 0.5


def test_marginals_match_enumeration():
    r = np.random.default_rng(2)
    e, move = r.uniform(0.2, 4, 6), r.uniform(0.2, 3, 4)
    m = move.reshape(2, 2)
    total, toxic = 0.0, np.zeros(6)
    for code in range(64):
        tags = [(code >> k) & 1 for k in range(6)]
        weight = np.prod([e[k] if t else 1.0 for k, t in enumerate(tags)]) * np.prod([m[a, b] for a, b in zip(tags, tags[1:])])
        total += weight
        toxic += weight * np.array(tags)
    ahead, back = T.forward_backward(e, np.array([0]), np.array([6]), move)
    assert np.allclose(ahead * back / (1 + ahead * back), toxic / total)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert T.fit(docs, labels) is None and T.fit(docs, labels.limit(0)) is None
    assert sorted(map(tuple, T.score(docs, None).collect())) == [(1, 0.0, []), (2, 0.0, [])]
    assert T.score(docs.limit(0), None).count() == 0


def test_inflected_stems_are_found(spark):
    """Each form of a toxic stem is rare, in two vocabularies; one stem also stands in a few clean documents."""
    r = random.Random(11)
    say = lambda letters: "".join(r.choice(letters) for _ in range(r.randrange(2, 8)))
    docs, labels = [], []
    for i in range(1600):
        letters, stem = (("abdeilmnorst", "zukvra"), ("éàuoxpqcèg", "Épaxo"))[i % 4 == 0]
        words, toxic = [say(letters) for _ in range(r.randrange(20, 90))], r.random() < 0.3
        for _ in range(r.randrange(1, 4) if toxic else 0):
            words.insert(r.randrange(len(words)), stem + say(letters))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    model = T.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels[:1100], "doc_id long, toxic int"))
    got = {x.doc_id: x.score >= 0.7 for x in T.score(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    for k in (0, 1):
        held = [i for i in range(1100, 1600) if (i % 4 == 0) == bool(k)]
        assert sum(got[i] for i in held if labels[i][1]) > 0.93 * sum(labels[i][1] for i in held)
        assert sum(got[i] for i in held if not labels[i][1]) < 0.03 * len(held)


def test_document_score_matches_plain_forward_backward(spark):
    """Whole texts, word by word: odds from features, both recursions, marginals, evidence, logistic."""
    rows, marks, _ = corpus(150, 9)
    rows += [(7, "Zukvra é\nplain words\ngroxpit"), (None, "vulkash vulkash"), (None, "vulkash vulkash"), (7, "x " * 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    cc, ct, tc, tt = model["move"]

    def plain(t):
        data = np.frombuffer(t.encode(), np.uint8)
        start, end, _, new = T.word_spans(data, np.array([0, len(data)]))
        e = [math.exp(model["bias"] + sum(float(model["weights"][k][b]) for k, b in enumerate(bs))) for bs in T.features(data, start, end, new).T]
        m, at = [], 0
        while at < len(e):
            stop = at + 1
            while stop < len(e) and not new[stop] and stop - at < T.CHAIN:
                stop += 1
            odds, n = e[at:stop], stop - at
            ahead, back = [(1.0, odds[0])], [(1.0, 1.0)] * n
            for o in odds[1:]:
                c, x = ahead[-1]
                c, x = cc * c + tc * x, (ct * c + tt * x) * o
                ahead.append((c / (c + x), x / (c + x)))
            for i in range(n - 2, -1, -1):
                c, x = back[i + 1]
                c, x = cc * c + ct * odds[i + 1] * x, tc * c + tt * odds[i + 1] * x
                back[i] = (c / (c + x), x / (c + x))
            m += [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(ahead, back)]
            at = stop
        strong = [x for x in m if x >= T.EVIDENCE]
        none = math.prod(1 - min(x, 1 - 1e-9) for x in strong)
        x = [math.log((1 - none + 1e-3) / (none + 1e-3)), math.log1p(sum(strong)), -math.log1p(len(m))]
        return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, model["score"])) + model["score"][-1])))

    got = sorted(x.score for x in T.score(docs, model).collect())
    assert np.allclose(got, sorted(plain(t) for _, t in rows), atol=1e-5)
