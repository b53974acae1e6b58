"""Language identification by averaged embeddings of hashed subwords under a linear softmax, trained by SGD in numpy.

A document is the mean of the embeddings of its subwords: the byte n-grams (1 to 4) within its words, with a word's edges
marked, hashed into BUCKETS rows. The softmax over it gives a language. As both layers are linear, a trained model is
folded into one table of BUCKETS x languages, and scoring a text is a sum of table rows over its bytes.

The model is fitted on the driver from about SAMPLE labelled documents (equal shares of the languages, chosen by a hash of
the row, but one of every language at least, however many there are); one in five of them calibrates: a temperature makes
scores probabilities, and the rejection level is the score below which only REJECT of the well-predicted ones fall (0.5
at most). Whole texts are read for both fitting and scoring, in chunks of bounded size.

Cases: a text that is null or has no letter gets 'und', score 0, and is rejected; without labelled documents every text
gets that; ties go to the first language by name; rows that repeat, and rows that share a doc_id or have none, are predicted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftglass.llm.buffers import LOWER, utf8
from driftglass.llm.storage import broadcast_if_small, small_batches, stored

BUCKETS, DIM, NGRAMS = 1 << 14, 16, 4
SAMPLE, REJECT, CHUNK, PROBE = 2000, 0.002, 1 << 17, 1 << 10
BATCH, EPOCHS, RATE = 16, 6, 8.0
UNKNOWN = "und"

_letters = np.zeros(256, np.uint8)  # lower-case letters and bytes beyond ASCII; all else is an edge of words
_letters[97:123] = np.arange(97, 123)
_letters[128:] = np.arange(128, 256)
LETTER = _letters[LOWER]


def grams(data: np.ndarray, offsets: np.ndarray, a: int, b: int) -> np.ndarray:
    """Buckets of the subwords that start at bytes a to b: one column for each length, BUCKETS where there is none."""
    piece = LETTER[data[a : min(len(data), b + NGRAMS - 1)]]
    n = b - a
    padded = np.zeros(n + NGRAMS - 1, np.uint32)
    padded[: len(piece)] = piece
    rows = np.searchsorted(offsets, [a, b - 1], side="right") - 1
    stops = offsets[rows[0] : rows[1] + 2].clip(a, b)
    left = np.repeat(offsets[rows[0] + 1 : rows[1] + 2], np.diff(stops)) - np.arange(a, b)  # bytes to the row's end
    out = np.empty((NGRAMS, n), np.int32)
    code = padded[:n].copy()
    inner = np.ones(n, bool)  # no edge strictly inside
    some = code > 0
    for k in range(1, NGRAMS + 1):
        if k > 1:
            if k > 2:
                inner &= padded[k - 2 : n + k - 2] > 0
            code = code | (padded[k - 1 : n + k - 1] << np.uint32(8 * (k - 1)))
            some = some | (padded[k - 1 : n + k - 1] > 0)
        h = (code ^ np.uint32(0x9E3779B9 * k & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        out[k - 1] = np.where(inner & some & (left >= k), h >> np.uint32(18), BUCKETS)
    return out


def chunk_rows(offsets: np.ndarray, a: int, b: int) -> tuple[int, np.ndarray]:
    """The first row that has bytes in a to b, and the bounds of the rows there."""
    first = int(np.searchsorted(offsets, a, side="right")) - 1
    last = int(np.searchsorted(offsets, b, side="left"))
    return first, offsets[first : last + 1].clip(a, b) - a


def has_letter(data: np.ndarray, offsets: np.ndarray, column: pa.Array) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, bool)
    for i in range(len(out)):
        for a in range(offsets[i], offsets[i + 1], PROBE):
            piece = data[a : min(a + PROBE, offsets[i + 1])]
            if ((LETTER[piece] > 0) & (piece < 128)).any():
                out[i] = True
                break
        else:
            out[i] = offsets[i + 1] > offsets[i] and any(c.isalpha() for c in column[i].as_py())
    return out


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The share of each bucket among a document's subwords."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        buckets, shares = [], []
        for i in range(len(batch)):
            total = np.zeros(BUCKETS + 1)
            text, ends = data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]])
            for a in range(0, len(text), CHUNK):
                total += np.bincount(grams(text, ends, a, min(len(text), a + CHUNK)).ravel(), minlength=BUCKETS + 1)
            at = np.flatnonzero(total[:BUCKETS])
            buckets.append(at.astype(np.int32))
            shares.append((total[at] / max(1, total[at].sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["lang", "buckets", "shares"]
        )


def training_sample(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """About `most` labelled documents, in equal shares of the languages as far as they have them, and one of each at least."""
    place = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / (1 << 40)).alias("place")
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", place)
    counts = stored(rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("first")), "languages")
    langs = counts.count()
    each = most / max(1, langs)
    chosen = rows.join(broadcast_if_small(counts), "lang").where(F.col("place") <= F.greatest(each / F.col("n"), F.col("first")))
    # copies say no more than one text
    return chosen.select("lang", "text").distinct().limit(2 * max(most, langs))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def dense(rows: list, at: np.ndarray) -> np.ndarray:
    x = np.zeros((len(at), BUCKETS), np.float32)
    for i, k in enumerate(at):
        x[i, rows[k][0]] = rows[k][1]
    return x


def train(samples: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 3) -> dict | None:
    """langs, table (BUCKETS + 1 rows, the last of zeros), bias, and the level below which a score is rejected."""
    if not samples:
        return None
    samples = sorted(samples, key=lambda s: (s[0], len(s[1]), s[1][:8].tolist(), float(s[2][:1].sum())))
    langs = sorted({s[0] for s in samples})
    y = np.array([langs.index(s[0]) for s in samples])
    rows = [(s[1], s[2]) for s in samples]
    r = np.random.default_rng(seed)
    order = r.permutation(len(rows))
    held, fit = (order[: len(order) // 5], order[len(order) // 5 :]) if len(order) >= 50 else (order, order)
    embed = r.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weight = r.normal(0, 1 / DIM, (len(langs), DIM)).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    steps = EPOCHS * -(-len(fit) // BATCH)
    done = 0
    for _ in range(EPOCHS):
        fit = r.permutation(fit)
        for a in range(0, len(fit), BATCH):
            at = fit[a : a + BATCH]
            rate = RATE * (1 - done / steps) / len(at)
            done += 1
            x = dense(rows, at)
            v = x @ embed
            g = softmax(v @ weight.T + bias)
            g[np.arange(len(at)), y[at]] -= 1
            gv = g @ weight
            weight -= rate / 8 * (g.T @ v)
            bias -= rate / 8 * g.sum(axis=0)
            used = np.unique(np.concatenate([rows[k][0] for k in at])) if len(at) else []
            embed[used] -= rate * 8 * (x[:, used].T @ gv)
    table = embed @ weight.T
    logits = np.array([rows[k][1] @ table[rows[k][0]] for k in held], np.float64).reshape(len(held), -1) + bias
    heats = np.geomspace(0.05, 20, 60)
    loss = [-np.log(softmax(logits * h)[np.arange(len(held)), y[held]] + 1e-12).mean() for h in heats]
    heat = heats[int(np.argmin(loss))]
    score = softmax(logits * heat)
    right = score.argmax(axis=1) == y[held]
    level = min(0.5, float(np.quantile(score.max(axis=1)[right], REJECT))) if right.any() else 0.0
    table = np.vstack([table * heat, np.zeros((1, len(langs)))]).astype(np.float32)
    return {"langs": langs, "table": table, "bias": (bias * heat).astype(np.float64), "level": level}


def predict_batches(shared, keep: bool = False):
    """Predictions; with keep, the rows that aren't rejected, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            n = len(batch)
            known = has_letter(data, offsets, batch.column("text"))
            lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if model is not None:
                total, many = np.zeros((n, len(model["langs"]))), np.zeros(n)
                for a in range(0, len(data), CHUNK):
                    b = min(len(data), a + CHUNK)
                    buckets = grams(data, offsets, a, b)
                    first, edges = chunk_rows(offsets, a, b)
                    sums = np.zeros((b - a + 1, total.shape[1]))
                    here = model["table"][buckets[0]]
                    for k in range(1, NGRAMS):
                        here += model["table"][buckets[k]]
                    np.cumsum(here, axis=0, out=sums[1:])
                    found = np.concatenate([[0], np.cumsum((buckets < BUCKETS).sum(axis=0))])
                    total[first : first + len(edges) - 1] += np.diff(sums[edges], axis=0)
                    many[first : first + len(edges) - 1] += np.diff(found[edges])
                p = softmax(total / np.maximum(many, 1)[:, None] + model["bias"])
                best = p.argmax(axis=1)
                lang[known] = np.array(model["langs"], object)[best][known]
                score[known] = p[np.arange(n), best][known]
            out = score < (model["level"] if model else 1)
            if keep:
                yield batch.filter(pa.array(~out & known))
                continue
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(out | ~known)], names=["doc_id", "lang_pred", "score", "rejected"]
            )

    return run


def fit(docs: DataFrame, most: int = SAMPLE) -> dict | None:
    """A model from the labelled rows of docs(doc_id, text, lang)."""
    small_batches(docs.sparkSession)
    rows = training_sample(docs, most).mapInArrow(count_batches, "lang string, buckets array<int>, shares array<float>").toArrow()
    lists = [[np.asarray(x.values) for x in rows.column(c)] for c in ("buckets", "shares")]
    return train(list(zip(rows.column("lang").to_pylist(), *lists)))


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats for each language
    return docs.select("doc_id", "text").mapInArrow(predict_batches(shared), "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of docs whose language the model recognises."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(predict_batches(shared, keep=True), docs.schema)


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))
