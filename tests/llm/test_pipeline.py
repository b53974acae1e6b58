import random
from collections import Counter

import corpus_pipeline as P
from driftglass.llm import queries as Q

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, rows, items):
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], COLUMNS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    r = random.Random(5)
    sounds = {"en": ["th", "er", "in", "the", "and"], "de": ["sch", "ung", "ein", "der"]}
    text = lambda lang, n=60: " ".join("".join(r.choice(sounds[lang]) for _ in range(r.randrange(1, 5))) for _ in range(n))
    item = text("en", 30)
    rows = [(i, text(lang) + "\nAll rights reserved", lang, f"s{i % 4}") for i in range(120) for lang in [r.choice(["en", "de"])]]
    rows += [(200, rows[3][1], "en", "s1"), (201, rows[3][1] + " more", "en", None), (202, text("en") + "\n" + item, "en", "s2"), (203, None, None, None), (204, "12 34", None, "s0"), (None, text("de"), "de", "s3")]
    docs = write(spark, tmp_path, rows, [(1, item)])
    kept = docs
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    left = {x.doc_id: x for x in kept.collect()}
    assert set(range(120)) | {None} == left.keys()
    assert not any("reserved" in x.text for x in left.values()) and all(x.n_chars == len(x.text) for x in left.values())
    mixed = P.run(spark, str(tmp_path))
    assert {x.doc_id for x in mixed.collect()} == left.keys()
    assert mixed.columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_whole_pipeline_matches_brute_force(spark, tmp_path):
    """Row by row: common lines, groups of near copies (one stays), verbatim items; language ID by its own test. doc_ids repeat."""
    r = random.Random(6)
    word = lambda: "".join(r.choice(["th", "er", "in", "the", "and", "ou"]) for _ in range(r.randrange(1, 5)))
    say = lambda n: " ".join(word() for _ in range(n))
    item, rows = say(25), []
    for i in range(70):
        body = [say(40) for _ in range(r.randrange(1, 4))] + ["share this page"] * (i % 3 == 0)
        rows.append((i % 60, "\n".join(body), "en", f"s{i % 3}"))
    rows += [(None, rows[k][1], "en", None) for k in (2, 4, 5)] + [(None, say(50), "en", "s0"), (None, say(50), "en", "s0"), (3, say(50), "en", "s1"), (90, say(20) + " " + item + " " + say(9), "en", "s1"), (3, item, "en", "s2")]
    write(spark, tmp_path, rows, [(1, item)])
    kept = dict(P.STAGES)["language_id"](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    rows = [(x.doc_id, x.text) for x in kept.collect()]
    assert len(rows) > 70
    seen = Counter(k for _, t in rows for k in {x.strip().lower() for x in t.split("\n")})
    rows = [(d, "\n".join(x for x in t.split("\n") if not x.strip() or seen[x.strip().lower()] < 10)) for d, t in rows]
    groups: list[list] = []
    for d, t in rows:
        w = t.lower().split()
        s = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        near = [g for g in groups if s and any(x and 100 * len(s & x) >= 75 * len(s | x) for _, _, x in g)]
        groups = [g for g in groups if g not in near] + [[(d, t, s), *(x for g in near for x in g)]]
    clean = [[t for _, t, _ in g] for g in groups if not any(item in t for _, t, _ in g)]
    left = kept
    for name, stage in P.STAGES[1:-1]:
        left = stage(spark, left, str(tmp_path))
    left = left.collect()
    assert len(left) == len(clean) and all(sum(x.text in g for x in left) == 1 for g in clean)
    mixed = P.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id or -1, x.size) for x in mixed) == sorted((x.doc_id or -1, len(x.text.split())) for x in left)
    sizes = Counter()
    for x in left:
        sizes[x.source] += len(x.text.split())
    assert sorted({x.source_size for x in mixed}) == sorted(set(sizes.values())) and all(x.taken <= 2 * x.size for x in mixed)


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert P.run(spark, str(tmp_path)).count() == 0


def test_names():
    assert [n.split("_")[0] for n in Q.queries()] == [f"op{i}" for i in range(1, 11)] and set(Q.oracle_sql()) <= set(Q.queries())
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
