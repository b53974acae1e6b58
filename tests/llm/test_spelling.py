import random
import re
import zlib
from collections import Counter

import pytest

from driftglass.llm import spelling as S

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits(a, b):
    """Whether b is a with exactly one character inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, least=7, times=2, factor=10, one_in=31):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    n = {w: k for w, k in n.items() if k >= times}
    near = {w: [u for u in n if edits(w, u)] for w in n}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda u: (-n[u], u))
            if n[best] >= factor * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    base = ["Colours", "harbour", "strasse", "Ärztliche", "ÉCOLIERS", "abcabcabc", "aaaaaaa", "aaaaaaaa", "baaaaaa", "internet", "internat", "interned", "a×b÷cdefg"]
    letters = "abcdeéß"

    def word():
        w = r.choice(base)
        for _ in range(r.choice([0, 0, 0, 0, 0, 1, 1, 2])):
            k, c = r.randrange(len(w) + 1), r.choice(letters)
            w = r.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])
        return w

    rows = [(i, " ".join(word() + r.choice(["", ",", ".", "1", "Œ"]) for _ in range(r.randrange(0, 60)))) for i in range(80)]
    rows += [(500 + i, "harbour internet aaaaaaa " * 40) for i in range(10)] + [(600, "harbourx harbourx harbourx harbourxx harbourxx")]
    return [*rows, (900, None), (901, ""), (None, "harbour harbuor Harbour"), rows[0], (902, "x" * 5000 + " " + "y" * 5000 + " " + "x" * 5000)]


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string").repartition(3)
    got = S.spelling_variants(S.word_counts(docs, one_in=31), **options)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize(("seed", "shard"), [(1, S.SHARD), (2, 24)])
def test_matches_brute_force(spark, seed, shard):
    rows = corpus(seed)
    got = run(spark, rows, shard=shard)
    assert got == brute(rows)
    assert any(g[1] for g in got) and max(g[4] for g in got) > 3


def test_chains_lead_to_the_last_form(spark):
    names = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb"]
    words = spark.createDataFrame([(w, 2 * 10**k) for k, w in enumerate(names)], "word string, n long")
    got = {r.word: (r.form, r.root) for r in S.spelling_variants(words).collect()}
    assert got == {w: (names[k + 1] if k < 4 else None, names[4]) for k, w in enumerate(names)}


def test_empty_table_and_pieces(spark):
    assert run(spark, []) == [] and run(spark, [(1, "one two"), (2, None)]) == []
    letter = re.compile(f"[{S.LETTERS}]")
    text = "abc de " * 50
    cut = list(S.pieces(text, letter, 16))
    assert "".join(cut) == text and len(cut) > 10 and sorted(w for p in cut for w in p.split()) == sorted(text.split())


def test_words_are_numbered_in_order():
    r = random.Random(3)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 8))) for _ in range(400)})
    automaton = S.Automaton(words)
    for k, w in enumerate(words):
        state, number = automaton.walk(automaton.start, 0, w)
        assert number == k and automaton.final[state]
        half = len(w) // 2
        assert automaton.one_error(w[:half], w[half:]) == {j for j, u in enumerate(words) if u.startswith(w[:half]) and edits(w, u)}
    assert len(automaton.final) < len(S.Automaton([w + str(k) for k, w in enumerate(words)]).final)
