"""Spelling variants: words that differ by one inserted, deleted or replaced character, grouped around the frequent ones.

1. Words: maximal runs of letters, A-Z lower-cased, counted over all texts; a task adds up before it sends.
2. Near words: two words at distance one agree in the first or in the second half of either. So every word asks for its
   partners under the key of its first half, and again, backwards, under that of its second half; it stands as a partner
   under every half that a word one shorter, as long or one longer may have.
3. A shard of keys gets a minimal acyclic automaton of its partners, forward or backward. Its states carry the number of
   words below them, so that a path also gives a word's number (its rank), which looks up the word and its count. The
   exact half is walked, the rest completed with one error. What is found backwards but also agrees in the first half is
   left out there, so every pair comes once and nothing need be made distinct across tasks.
4. A word's form is its near word of largest count if that is at least FACTOR times its own; roots follow forms by
   doubling, as counts grow by FACTOR a step.

Scale: words are hashed to shards of about SHARD rows. A key with more than half of that is split: its partners and its
askers are dealt in blocks, and each pair of blocks is a cell of its own. An asker keeps a count and its best partner.

Cases: a null text has no words; a null doc_id counts as an empty string in the damage of `damaged`. Equal rows count each.
Long texts are read in pieces that end between runs. Words are compared by code points. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass.llm.storage import broadcast_if_small, small_batches, stored

LETTERS = "A-Za-zÀ-ÿ"
LEAST_CHARS, LEAST_COUNT, FACTOR, DAMAGE = 7, 2, 10, 31
SHARD, FLUSH, PIECE = 16_384, 200_000, 1 << 20


def pieces(text: str, letter: re.Pattern, most: int = PIECE) -> Iterator[str]:
    """Stretches of a text of about `most` characters; none cuts a run of letters."""
    first = 0
    while len(text) - first > most:
        cut = first + most
        while cut < len(text) and letter.match(text, cut):
            cut += 1
        yield text[first:cut]
        first = cut
    yield text[first:]


def damaged(word: str, seed: int, one_in: int) -> str:
    """The word, without one of its characters where a checksum of it and its document (seed) says so."""
    h = zlib.crc32(word.encode(), seed)
    if h % one_in:
        return word
    cut = h % len(word)
    return word[:cut] + word[cut + 1 :]


def count_batches(least: int, one_in: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, letter = re.compile(f"[{LETTERS}]{{{least},}}"), re.compile(f"[{LETTERS}]")
        total: Counter[str] = Counter()
        send = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                own: Counter[str] = Counter()
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for piece in pieces(text.as_py() or "", letter):
                    own.update(runs.findall(piece.encode().lower().decode()))  # bytes lower-case A-Z alone
                    if len(own) > FLUSH or len(total) > FLUSH:
                        yield from spent(own, total, seed, least, one_in, send)
                yield from spent(own, total, seed, least, one_in, send)
        yield send()

    return run


def spent(own: Counter, total: Counter, seed: int, least: int, one_in: int | None, send: Callable) -> Iterator[pa.RecordBatch]:
    """Moves a document's counts to those of the task, and sends these when they are many."""
    for word, n in own.items():
        word = damaged(word, seed, one_in) if one_in else word
        if len(word) >= least:
            total[word] += n
    own.clear()
    if len(total) > FLUSH:
        yield send()
        total.clear()


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, one_in: int | None = None) -> DataFrame:
    """word, n of docs(doc_id, text). one_in: one word in so many of a document loses a character first."""
    small_batches(docs.sparkSession)
    found = docs.select("doc_id", "text").mapInArrow(count_batches(least_chars, one_in), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Automaton:
    """A minimal acyclic automaton of sorted distinct words that numbers them in order."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []  # of a state: character -> (state, words passed over)
        self.final: list[bool] = []
        self.below: list[int] = []
        known: dict[tuple, int] = {}

        def frozen(final: bool, out: list[tuple[str, int]]) -> int:
            state = known.get(key := (final, *out))
            if state is None:
                state = known[key] = len(self.final)
                passed, edges = int(final), {}
                for c, to in out:
                    edges[c] = (to, passed)
                    passed += self.below[to]
                self.edges.append(edges)
                self.final.append(final)
                self.below.append(passed)
            return state

        path: list[list] = [[False, []]]  # the states along the last word, still open
        last = ""
        for word in [*words, ""]:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            for depth in range(len(last), same, -1):
                path[depth - 1][1].append((last[depth - 1], frozen(*path.pop())))
            path.extend([False, []] for _ in word[same:])
            if word:
                path[-1][0] = True
            last = word
        self.start = frozen(*path[0])

    def walk(self, state: int, number: int, rest: str, first: int = 0) -> tuple[int, int] | None:
        """Where rest[first:] leads, and the words passed over."""
        edges = self.edges
        for k in range(first, len(rest)):
            step = edges[state].get(rest[k])
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def one_error(self, exact: str, rest: str) -> set[int]:
        """Numbers of the words that begin with `exact` and go on with rest but for one error."""
        found: set[int] = set()
        at = self.walk(self.start, 0, exact)
        final, edges, walk = self.final, self.edges, self.walk

        def end(state: int, number: int, first: int) -> None:
            if (to := walk(state, number, rest, first)) is not None and final[to[0]]:
                found.add(to[1])

        for k in range(len(rest) + 1):
            if at is None:
                break
            state, number = at
            if k < len(rest):
                end(state, number, k + 1)  # one less
            for c, (to, passed) in edges[state].items():
                end(to, number + passed, k)  # one more
                if k < len(rest) and c != rest[k]:
                    end(to, number + passed, k + 1)
            step = edges[state].get(rest[k]) if k < len(rest) else None
            at = step and (step[0], number + step[1])
        return found


FOUND = "word string, n_near long, best long, form string"


def near_in_cell(rows: pd.DataFrame) -> pd.DataFrame:
    """For the askers of a cell(back, word, n, asks, held): how many near words it holds, and the most frequent of them."""
    out = []
    for back, part in rows.groupby("back"):
        turned = (lambda w: w[::-1]) if back else (lambda w: w)
        held = part[part.held].drop_duplicates("word")
        counts = {turned(w): n for w, n in zip(held.word, held.n)}
        words = sorted(counts)
        automaton = Automaton(words)
        for word in part.word[part.asks]:
            half = len(word) // 2
            exact, rest = (word[half:][::-1], word[:half][::-1]) if back else (word[:half], word[half:])
            near = [words[k] for k in automaton.one_error(exact, rest)]
            if back:
                near = [w for w in near if not w.endswith(word[:half][::-1])]
            if near:
                n, form = min((-int(counts[w]), turned(w)) for w in near)
                out.append((word, len(near), -n, form))
    return pd.DataFrame(out, columns=["word", "n_near", "best", "form"])


def keyed(words: DataFrame) -> DataFrame:
    """back, key, word, n, asks of words(word, n): twice a direction, under the halves that it has and that near words may have."""
    size = F.length("word")
    forward = F.array_distinct(F.array(*(F.floor((size + d) / 2) for d in (-1, 0, 1))))
    backward = F.array_distinct(F.array(*(size + d - F.floor((size + d) / 2) for d in (-1, 0, 1))))
    one = lambda back, reach, own, cut: words.select(F.lit(back).alias("back"), "word", "n", F.explode(reach).alias("reach")).select("back", cut.alias("key"), "word", "n", (F.col("reach") == own).alias("asks"))
    first = one(False, forward, F.floor(size / 2), F.expr("left(word, int(reach))"))
    second = one(True, backward, size - F.floor(size / 2), F.expr("right(word, int(reach))"))
    return first.unionByName(second)


def dealt(rows: DataFrame, shard: int) -> DataFrame:
    """Adds cell and held to keyed rows: what stands in one cell is compared there, askers with what is held."""
    many = rows.groupBy("back", "key").agg(F.count("*").alias("rows"))
    many = stored(many.where(F.col("rows") > shard // 2).withColumn("blocks", F.ceil(F.col("rows") / (shard // 2)).cast("int")), "frequent-halves")
    shards = rows.count() // shard + 1
    small = F.concat_ws("|", F.lit("s"), F.pmod(F.xxhash64("back", "key"), F.lit(shards)).cast("string"))
    if not many.take(1):
        return rows.select(small.alias("cell"), "back", "word", "n", "asks", F.lit(True).alias("held"))
    rows = rows.join(broadcast_if_small(many.drop("rows")), ["back", "key"], "left")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.coalesce(F.sequence(F.lit(0), F.col("blocks") - 1), F.array(F.lit(0)))))
    name = lambda held, asks: F.concat_ws("|", "key", *(F.col(c).cast("string") for c in ("back", held, asks)))
    alone = rows.where("blocks IS NULL").select(small.alias("cell"), "back", "word", "n", "asks", F.lit(True).alias("held"))
    as_held = rows.where("blocks IS NOT NULL").select(name("own", "other").alias("cell"), "back", "word", "n", (F.col("asks") & (F.col("own") == F.col("other"))).alias("asks"), F.lit(True).alias("held"))
    as_asker = rows.where("blocks IS NOT NULL AND asks AND own <> other").select(name("other", "own").alias("cell"), "back", "word", "n", "asks", F.lit(False).alias("held"))
    return alone.unionByName(as_held).unionByName(as_asker)


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """word, n_near, best, form of words(word, n) that have near words: how many, and the count and name of the first by count."""
    cells = dealt(keyed(words), shard)
    found = cells.groupBy("cell").applyInPandas(near_in_cell, FOUND)
    first = F.min(F.struct((-F.col("best")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select("word", "n_near", (-F.col("first.less")).alias("best"), "first.form")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms(word, form): what following forms to the last gives; twice as far with each round."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        far = stored(far.join(now.select("root").distinct(), "root", "left_semi"), "roots-of-roots")
        if not far.take(1):
            return now
        now = stored(now.join(broadcast_if_small(far), "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")


def spelling_variants(words: DataFrame, factor: int = FACTOR, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n of words(word, n), which are distinct."""
    if factor <= 1:
        raise ValueError("a form must be more frequent than its word")
    words = stored(words.select("word", "n"), "words")
    found = stored(near_words(words, shard), "near-words")
    rows = words.join(found, "word", "left")
    chosen = F.col("best") >= factor * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("form")).alias("form"), F.when(chosen, F.col("best")).alias("form_n"))
    rows = stored(rows, "formed")
    rows = rows.join(roots(rows.where("form IS NOT NULL").select("word", "form")), "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
