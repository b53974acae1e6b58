import hashlib
import random

import pytest

from driftglass.llm import chat_format as C

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(rows):
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, _, r, x in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(said), sha(said)))
    return sorted(out, key=str)


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json"])
@pytest.mark.parametrize("segment", [20, C.SEGMENT])
def test_round_trip(spark, vocabulary, segment):
    r = random.Random(4)
    bits = ["a", "é", "日本", " ", "\n", "🙂", "<|", "|>", "<|turn|>", "<|end|>", "\x1a", "\x1ae", "<\x1a|", "[INST]", "</s>", "<", "|", "e", "word", "  "]
    say = lambda: "".join(r.choice(bits) for _ in range(r.randrange(0, 25)))
    rows = [(c, t, r.choice(["user", "assistant", "system"]), say(), 1) for c in range(40) for t in range(r.randrange(1, 8))]
    rows += [(-7, t, x, "</s>[INST] ok [/INST]", 1) for t, x in enumerate(("user", "assistant"))]
    rows += [(50, 0, None, None, 1), (50, None, "assistant", None, 1), (None, 0, "assistant", "null id", 1), (51, 0, "assistant", "tie b", 1), (51, 0, "assistant", "tie a", 1), (51, 0, "assistant", "tie a", 1)]
    rows += [(60, t, "assistant", "long " * 300, 1) for t in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")
    segments = C.format_conversations(df, public.path(vocabulary), segment)
    got = C.digests(segments).collect()
    assert sorted((tuple(x)[:5] for x in got), key=str) == brute(rows)
    assert sum(x.n_tokens for x in got) == sum(len(x.input_ids) for x in segments.collect())


def test_escape_is_reversible_and_hides_control():
    r = random.Random(9)
    for _ in range(3000):
        x = "".join(r.choice("<|>\x1aetur") for _ in range(r.randrange(0, 12)))
        assert C.unescape(C.escape(x)) == x and "<|" not in C.escape(x)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.digests(C.format_conversations(df, public.path("byte_bpe_50k.json"))).count() == 0
