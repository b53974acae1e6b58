"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Words are tagged clean or toxic. The training labels are those of documents, so words are labelled first, by their parts: a
word itself, and its beginnings and ends of AFFIX bytes, as inflected forms share a stem while each form is rare. Of the parts
that are surely more frequent in toxic documents than in clean ones (a likelihood-ratio test that allows for the number of
parts tried), a greedy cover takes again and again the one that explains most toxic documents not yet explained, less the
clean ones it is also in. In toxic documents, words with a part of the cover, or with one that hardly occurs in clean
documents, are labelled toxic; all other words are labelled clean. The field has hashed features of a word, its beginnings
and ends and its neighbours, and transition weights; SGD in numpy follows the gradient, empirical minus expected counts,
from forward-backward marginals, with steps scaled by what each weight has seen.

A document's score is a logistic function, fitted on the sample's documents, of the log-odds that it has a toxic word
(from the marginals), of how many, and of how many words it has. Offsets of its toxic spans are maximal runs of words with a
marginal of a half or more.

A chain is a line of text, cut after CHAIN words; chains of a piece of text advance together, so one step of the recursion is one array
operation. Fitting uses at most SAMPLE labelled documents (half of them toxic, as far as there are; chosen by a hash of
doc_id) of at most SAMPLE_BYTES each; scoring reads whole texts.

Cases: null and empty texts, and texts without words, are scored by the document function at no evidence and have no
spans; without a toxic and a clean document to learn from all scores are 0; equal labels for one doc_id count once, and of
unequal ones the greater; null labels and null doc_ids are not learned from; rows that share a doc_id are learned from and
scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass.llm.buffers import BYTE_VALUE, LOWER, mix, prefix_sums, row_pieces, span_hash, utf8

BITS, CHAIN, SAMPLE, SAMPLE_BYTES = 18, 96, 3000, 1 << 17
AFFIX = (4, 5, 6, 7, 8, 9)  # bytes of the beginnings and ends that parts are taken from
SURE, RARE, EXCLUSIVE, COVER_LEAST = 12.0, 0.25, 0.03, 0.004
BASE = 0x9E3779B97F4A7C15
FIRST, LAST = (3, 4, 5, 6, 8), (3, 4, 6)  # bytes of the beginnings and ends that are features
KINDS = 3 + len(FIRST) + len(LAST)  # and the word, the one before, the one after
EPOCHS, STEPS, CHAINS_AT_ONCE, RATE, DECAY = 4, 60, 512, 0.3, 1e-5
EVIDENCE = 0.02  # marginals below count as none
PIECE = 1 << 21

IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes of a text with A-Z and the capitals of two bytes up to U+00DE in lower case."""
    out = LOWER[data]
    if len(out) > 1:
        accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][accented] += 0x20
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end, row and chain-break flag of every run of letters."""
    solid = IS_LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    lines = np.searchsorted(np.flatnonzero(data == 10), start)
    new = np.ones(len(start), bool)
    new[1:] = (row[1:] != row[:-1]) | (lines[1:] != lines[:-1])
    return start, end, row, new


def chains(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of each chain."""
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(new)))
    parts = -(-size // CHAIN)
    part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(first, parts) + part * CHAIN
    return begin, np.minimum(CHAIN, np.repeat(first + size, parts) - begin)


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each word KINDS feature buckets (one row each)."""
    sums = prefix_sums(BYTE_VALUE[lowered(data)], BASE)
    word = span_hash(sums, start, end, BASE)
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:] = np.where(new[1:], 0, word[:-1])
    after[:-1] = np.where(new[1:], 0, word[1:])
    kinds = [word, before, after]
    kinds += [span_hash(sums, start, np.minimum(start + k, end), BASE) for k in FIRST]
    kinds += [span_hash(sums, np.maximum(end - k, start), end, BASE) for k in LAST]
    return np.stack([(mix(x + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int32) for k, x in enumerate(kinds)])


def parts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each word the hashes of its parts: itself, beginnings, ends; 0 where it is too short for a part of its own."""
    sums = prefix_sums(BYTE_VALUE[lowered(data)], BASE)
    out = [span_hash(sums, start, end, BASE)]
    for k in AFFIX:
        longer = end - start > k
        out.append(np.where(longer, mix(span_hash(sums, start, np.minimum(start + k, end), BASE) + np.uint64(1)), 0))
        out.append(np.where(longer, mix(span_hash(sums, np.maximum(end - k, start), end, BASE) + np.uint64(2)), 0))
    return np.stack(out)


def forward_backward(e: np.ndarray, first: np.ndarray, size: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odds of toxic against clean at every word, from what lies before (itself included) and from what follows.

    e: the words' own odds; move: weights (not logs) clean-clean, clean-toxic, toxic-clean, toxic-toxic.
    """
    cc, ct, tc, tt = move
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    ahead, back = np.empty_like(e), np.ones_like(e)
    at = first
    if len(first):
        ahead[at] = e[at]
    for t in range(1, len(active)):
        at = first[: active[t]] + t
        f = ahead[at - 1]
        ahead[at] = np.clip(e[at] * (ct + tt * f) / (cc + tc * f), 1e-30, 1e30)
    for t in range(len(active) - 1, 0, -1):
        at = first[: active[t]] + t
        g = e[at] * back[at]
        back[at - 1] = (tc + tt * g) / (cc + ct * g)
    return ahead, back


def own_odds(weights: np.ndarray, bias: float, buckets: np.ndarray) -> np.ndarray:
    z = np.full(buckets.shape[1], bias)
    for k in range(KINDS):
        z += weights[k][buckets[k]]
    return np.exp(np.clip(z, -60, 60))


def fit_field(buckets: np.ndarray, y: np.ndarray, first: np.ndarray, size: np.ndarray, seed: int = 5) -> dict:
    r = np.random.default_rng(seed)
    weights, seen_w = np.zeros((KINDS, 1 << BITS)), np.full((KINDS, 1 << BITS), 1.0)
    bias, log_move = -4.0, np.zeros(4)
    at_once = int(np.clip(len(first) // STEPS, 1, CHAINS_AT_ONCE))  # so that few chains make as many steps
    for epoch in range(EPOCHS):
        order = r.permutation(len(first))
        for a in range(0, len(order), at_once):
            some = order[a : a + at_once]
            at = np.concatenate([np.arange(f, f + s) for f, s in zip(first[some], size[some])])
            starts = np.cumsum(size[some]) - size[some]
            b, labels = buckets[:, at], y[at]
            e, move = own_odds(weights, bias, b), np.exp(log_move)
            ahead, back = forward_backward(e, starts, size[some], move)
            odds = ahead * back
            m = odds / (1 + odds)
            g = labels - m
            inner = np.ones(len(at), bool)
            inner[starts] = False
            i = np.flatnonzero(inner)
            f, nxt = ahead[i - 1], e[i] * back[i]
            pairs = np.stack([move[0] * np.ones(len(i)), move[1] * nxt, move[2] * f, move[3] * f * nxt])
            pairs /= pairs.sum(axis=0)
            seen = np.array([((labels[i - 1] == p) & (labels[i] == q)).sum() for p in (0, 1) for q in (0, 1)])
            rate = 0.5 / (1 + epoch)
            step = (seen - pairs.sum(axis=1)) / max(50, labels.sum())
            log_move += rate * np.clip(step, -1, 1)
            log_move -= log_move[0]
            bias += rate * float(np.clip(g.sum() / max(50, labels.sum()), -1, 1))
            near = np.flatnonzero(np.abs(g) > 1e-4)
            for k in range(KINDS):
                used, where = np.unique(b[k][near], return_inverse=True)
                pull = np.bincount(where, weights=g[near], minlength=len(used))
                seen_w[k, used] += pull * pull
                weights[k, used] += RATE * pull / np.sqrt(seen_w[k, used])
            weights *= 1 - DECAY
    return {"weights": weights.astype(np.float32), "bias": bias, "move": np.exp(log_move)}


def evidence(field: dict, buckets: np.ndarray, new: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the words, and for each row: log-odds of a toxic word, log of their expected number, log of words."""
    first, size = chains(new) if len(new) else (np.zeros(0, np.int64),) * 2
    ahead, back = forward_backward(own_odds(field["weights"], field["bias"], buckets), first, size, field["move"])
    odds = ahead * back
    m = odds / (1 + odds)
    strong = np.where(m >= EVIDENCE, m, 0)
    clean = np.bincount(row, weights=np.log1p(-np.minimum(strong, 1 - 1e-9)), minlength=rows)
    many = np.bincount(row, weights=strong, minlength=rows)
    none = np.exp(clean)
    x = np.stack([np.log((1 - none + 1e-3) / (none + 1e-3)), np.log1p(many), -np.log1p(np.bincount(row, minlength=rows))], axis=1)
    return m, x


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -40, 40)))


def fit_score(x: np.ndarray, y: np.ndarray, shrink: float = 1e-2) -> np.ndarray:
    """Newton's method for a logistic regression with a little shrinkage; weights of evidence are not negative."""
    w = np.zeros(x.shape[1] + 1)
    one = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -40, 40)))
        h = one.T @ (one * (p * (1 - p))[:, None]) / len(y) + shrink * np.eye(len(w))
        w = w + np.linalg.solve(h, one.T @ (y - p) / len(y) - shrink * w)
        w[:-1] = np.maximum(w[:-1], 0)
    return w


def toxic_parts(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The parts that label words toxic, from the distinct parts of documents and the documents' labels."""
    toxic, clean = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    keys, inside = np.unique(np.concatenate([d for d, label in zip(docs, y) if label]), return_counts=True)
    outside = np.zeros(len(keys), np.int64)
    for d, label in zip(docs, y):
        if not label and len(keys):
            at = np.minimum(np.searchsorted(keys, d), len(keys) - 1)
            outside[at[keys[at] == d]] += 1
    # twice the log-likelihood ratio of two rates against one; the level grows with the parts that are tried
    t, c = inside.astype(float), outside.astype(float)
    both = (t + c) / (toxic + clean)
    ratio = 2 * (t * np.log(t / (toxic * both)) + c * np.log(np.maximum(c, 1e-300) / (clean * both)))
    good = (ratio >= SURE + 2 * np.log(len(keys) + 1)) & (c / clean <= RARE * t / toxic) & (keys != 0)
    keys, t, c = keys[good], t[good], c[good]
    if not len(keys):
        return keys
    held = [np.searchsorted(keys, np.intersect1d(d, keys)) for d in docs]
    weight = np.where(y == 1, 1 / toxic, -1 / clean)
    gain = np.zeros(len(keys))
    for h, w in zip(held, weight):
        gain[h] += w
    left, chosen = set(range(len(docs))), []
    where = [[] for _ in keys]
    for i, h in enumerate(held):
        for k in h.tolist():
            where[k].append(i)
    while gain.max() >= COVER_LEAST:
        best = int(gain.argmax())
        chosen.append(best)
        for i in where[best]:
            if i in left:
                left.discard(i)
                gain[held[i]] -= weight[i]
        gain[best] = -1
    # parts that explain no further document alone, but are as telling
    return np.union1d(keys[chosen], keys[c / clean <= EXCLUSIVE * t / toxic])


def train(texts: list[np.ndarray], y: np.ndarray) -> dict | None:
    if not len(y) or y.min() == y.max():
        return None
    spans = [word_spans(text, np.array([0, len(text)])) for text in texts]
    held = [np.unique(parts(text, s[0], s[1])) for text, s in zip(texts, spans)]
    # copies say no more than one text: of documents with the same smallest parts, one counts
    smallest = [tuple(h[:8].tolist()) if len(h) > 8 else i for i, h in enumerate(held)]
    once = sorted({k: i for i, k in reversed(list(enumerate(smallest)))}.values())
    seeds = toxic_parts([held[i] for i in once], y[once])
    labels = [np.isin(parts(text, s[0], s[1]), seeds).any(axis=0) & (label == 1) for text, s, label in zip(texts, spans, y)]
    buckets = np.concatenate([features(text, s[0], s[1], s[3]) for text, s in zip(texts, spans)], axis=1)
    new = np.concatenate([s[3] for s in spans])
    row = np.repeat(np.arange(len(y)), [len(s[0]) for s in spans])
    first, size = chains(new) if len(new) else (np.zeros(0, np.int64),) * 2
    field = fit_field(buckets, np.concatenate(labels).astype(np.int64), first, size)
    _, x = evidence(field, buckets, new, row, len(y))
    return field | {"score": fit_score(x, y)}


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict | None:
    """A model from docs(doc_id, text) and labels(doc_id, toxic)."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("toxic") == 1, F.lit(most / 2 / counts[1])).otherwise(F.lit(most / 2 / counts[0]))
    chosen = known.where(place < share).limit(2 * most)  # so small that it can go to every executor
    short = F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES
    rows = docs.select("doc_id", "text").where(short).join(F.broadcast(chosen), "doc_id").limit(4 * most)
    rows = rows.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    data, offsets = utf8(rows.column("text").combine_chunks())
    return train([data[a:b] for a, b in zip(offsets, offsets[1:])], rows.column("toxic").to_numpy().astype(np.int64))


SCHEMA = "doc_id long, score double, spans array<struct<start: int, end: int>>"


def score_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for r, s in row_pieces(offsets, PIECE):
                at = offsets[r : s + 1]
                piece, at = data[at[0] : at[-1]], at - at[0]
                start, end, row, new = word_spans(piece, at)
                spans: list[list] = [[] for _ in range(s - r)]
                score = np.zeros(s - r)
                if model is not None:
                    buckets = features(piece, start, end, new)
                    m, x = evidence(model, buckets, new, row, s - r)
                    score = logistic(x, model["score"])
                    hit = np.flatnonzero(m >= 0.5)
                    for k, i in enumerate(hit):
                        mine, base = spans[row[i]], at[row[i]]
                        if k and hit[k - 1] == i - 1 and not new[i]:
                            mine[-1]["end"] = int(end[i] - base)
                        else:
                            mine.append({"start": int(start[i] - base), "end": int(end[i] - base)})
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(r, s - r), pa.array(score), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    return run


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score and spans (byte offsets of the UTF-8 text) of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # KINDS x 2**BITS floats
    return docs.select("doc_id", "text").mapInArrow(score_batches(shared), SCHEMA)
