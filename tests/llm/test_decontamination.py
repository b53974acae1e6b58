import random
import re

from pyspark.sql import functions as F

from driftglass.llm import decontamination as D
from driftglass.llm.decontamination import contaminated, decontaminated

ITEM = "A train leaves Paris and meets Anna after 30 km of track while Bob waits 12 minutes for the second train to Lyon near the bridge"
LONG = " ".join(f"plain{i} word{i}" for i in range(12)).replace("0", "o")


def docs_of(spark, rows):
    return spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, item_id int")


def test_finds_verbatim_and_reparameterised(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "one two three four five six"), (3, "too short"), (4, None), (5, "we ask who paid and who ran and who sat and who left the old house on the hill")], "item_id long, text string")
    other = ITEM.replace("Paris", "Rome").replace("30 km", "7.5 miles").replace("Anna", "Zoe").replace("12", "99")
    twice = "In the story Tom saw 5 boats and then Tom saw 5 boats and later Tom sold 5 boats at the quiet old harbour wall"
    bench = bench.union(spark.createDataFrame([(6, twice)], "item_id long, text string"))
    broken = twice.replace("Tom sold 5", "Kim sold 8")
    kept = twice.replace("Tom", "Kim").replace("5", "17")
    rows = [(1, f"Some words first. {ITEM}. More."), (2, f"Some words first. {other}. More."), (3, "x y z one TWO three, four five six seven"), (4, None), (5, ""), (6, broken), (7, kept),
            (8, "a train leaves home and nothing else here is like the benchmark at all"), (None, ITEM), (9, "too short"), (1, "nothing")]
    got = {(r.doc_id, r.item_id) for r in contaminated(docs_of(spark, rows), bench).collect()}
    assert got == {(1, 1), (2, 1), (None, 1), (3, 2), (7, 6), (9, 3)}
    left = decontaminated(docs_of(spark, rows), bench)
    assert left.columns == ["doc_id", "text", "item_id"]
    assert sorted(r.doc_id for r in left.collect()) == [4, 5, 6, 8]


def test_plain_words_match_brute_force(spark):
    r = random.Random(3)
    items = [" ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.randrange(3, 30))) for _ in range(20)]
    rows = []
    for i in range(120):
        words = [r.choice("abcdefgh") + r.choice("xyz") for _ in range(30)]
        item = r.choice(items).split()
        a = r.randrange(len(item))
        rows.append((i, " ".join(words + item[a : a + r.randrange(1, 30)] + words[:9])))
    want = set()
    for k, item in enumerate(items):
        w = item.split()
        size = min(8, len(w))
        if size < 5:
            continue
        have = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)}
        places = [tuple(w[j : j + size]) for j in range(len(w) - size + 1)]
        for i, t in rows:
            d = re.findall(r"\w+", t)
            found = {tuple(d[j : j + size]) for j in range(len(d) - size + 1)} & have
            if sum(p in found for p in places) >= min(4, len(places)):
                want.add((i, k))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in contaminated(docs_of(spark, rows), bench).collect()}
    assert got == want and len(want) > 20


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of(spark, [(1, LONG)])
    assert contaminated(docs, none).count() == 0
    assert decontaminated(docs, none).count() == 1
    bench = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    assert contaminated(docs.limit(0), bench).count() == 0
    assert [tuple(r)[:4] for r in contaminated(docs, bench).collect()] == [(1, 1, 17, 17)]


def test_values_keep_their_places_behind_punctuation(spark):
    item = "A truck drives 30 km to the harbour, waits, drives another 45 km up the coast and then goes 30 km back home"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    before = ["", "It weighs 2.5 kg. ", "It is 1,000 km long. ", "See https://a.example.com/x/y?z=1.2 or state-of-the-art work. ", "At 10:30, 3/4 of 1.5% or 5 km/h. "]
    other = item.replace("30", "7.5").replace("45", "1,200")
    broken = item.replace("30 km back", "31 km back")
    texts = [b + x for b in before for x in (item, other, broken)]
    got = {r.doc_id: r.matched for r in contaminated(docs_of(spark, list(enumerate(texts))), bench).collect()}
    assert got == {i: 16 for i in range(len(texts)) if i % 3 < 2}


def test_finds_number_lists_names_and_other_case(spark):
    sums = "Compute 12 + 7 * 3 - 4 / 2 and 5 * 6 + 8 - 9"
    people = "guests: Anna, Bob, Carl, Dora, Emil, Fred, Gina, Hugo, Ines, Jack"
    apples = "Tom has 3 apples. Tom buys 5 more. How many apples does Tom have?"
    town = "In spring the old town of Paris opens its gates to Anna and her friends for one long week"
    bench = spark.createDataFrame(list(enumerate([sums, people, apples, town])), "item_id long, text string")
    texts = [f"We saw this. {sums}.", f"We saw this. {people}.", apples.replace("Tom", "Anna").replace("5", "9"), town.title(), town.upper(), town.lower(),
             sums.replace("7", "8").replace("12", "15").replace("6", "1"), people.replace("Carl", "Kurt").replace("Fred", "Finn")]
    got = {(r.doc_id, r.item_id) for r in contaminated(docs_of(spark, list(enumerate(texts))), bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 3), (5, 3)}


def test_names_at_the_start_of_sentences_are_slots(spark):
    item = "Janet has 16 ducks. Janet sells the eggs of her ducks at the old market every day. How much does she earn in 4 weeks?"
    other = "The old man sold the eggs at the market. She and her ducks have time, and how much is left does not matter"
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    same = item.replace("Janet", "Sofia").replace("16", "19")
    two = same.replace("Sofia sells", "Helen sells")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs_of(spark, [(1, item), (2, same), (3, two), (4, f"Text before. {same}")]), bench).collect()}
    assert got == {(1, 1), (2, 1), (4, 1)}


def test_short_items_are_found_as_lines(spark):
    bench = spark.createDataFrame([(1, "What is 2+2?"), (2, "Yes."), (3, "one\ntwo"), (4, "?!"), (5, None)], "item_id long, text string")
    rows = [(1, "first\n what is 2 + 2\nlast"), (2, "He asked what is 2+2 and left"), (3, "YES"), (4, "yes and no"), (5, "one two"), (6, "?!"), (7, None), (None, "yes")]
    got = {(r.doc_id, r.item_id, r.matched, r.n_windows) for r in contaminated(docs_of(spark, rows), bench).collect()}
    assert got == {(1, 1, 1, 1), (3, 2, 1, 1), (5, 3, 1, 1), (None, 2, 1, 1)}


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    r = random.Random(7)
    item = "A truck drives 30 km to the harbour, waits for Anna, drives another 45 km up the coast and then goes 30 km back home"
    bench = spark.createDataFrame([(1, item), (2, "Only a few short words stand here"), (3, "What is 2+2?"), (4, "Every 3 kg. 5 cm! Then 7 km of road? Nobody knows how far the old mill is. It is there")], "item_id long, text string")
    say = lambda n: " ".join(f"w{r.randrange(500)}" + r.choice(["", "", ",", ".", "!", "\n", " 3 km.", " Then Bob"]) for _ in range(n))
    rows = [(i, " ".join([say(r.randrange(900)), r.choice([item, item.replace("30", "7"), item.replace("30 km back", "31 km back"), "", "Only a few short words stand here."]), say(30), r.choice(["\nwhat is 2 + 2\n", bench.collect()[3].text, ""]), say(r.randrange(900))])) for i in range(40)]
    rows += [(50, "no end " * 500 + item), (51, ""), (52, None)]
    ask = lambda: sorted((x.doc_id, x.item_id, x.matched) for x in contaminated(docs_of(spark, rows), bench).collect())
    whole = ask()
    monkeypatch.setattr(D, "PIECE", 150)
    monkeypatch.setattr(D, "OVERLAP", 300)
    assert ask() == whole and len({k for _, k, _ in whole}) == 4


def test_windows_of_one_template_share_hashes(spark):
    r = random.Random(9)
    pick = ["a", "b", "Anna", "Bob", "3", "4 km", "5 kg", "NATO", "c.", "d,"]
    texts = [" ".join(r.choice(pick[: r.choice([4, 8, 10])] if i % 2 else pick[2:7]) for _ in range(r.randrange(1, 24))) for i in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").withColumn("raw", D.raw_words(F.col("text")))
    words = {x.k: x.w for x in rows.select("k", D.template_words(F.col("raw")).alias("w")).collect()}
    got = D.windows(rows.drop("text"), F.col("raw"), F.array(F.lit(2), F.lit(3), F.lit(5))).collect()
    assert sorted((x.k, x.width, x.at) for x in got) == [(k, w, a) for k in words for w in (2, 3, 5) for a in range(len(words[k]) - w + 1)]
    by_template, by_hash, dense = {}, {}, 0
    for x in got:
        window = words[x.k][x.at : x.at + x.width]
        valued = 2 * sum(w.v[0] in D.MARK + D.UNIT for w in window) > x.width
        dense += valued
        for name in ("folded", "inner", "capital"):
            template = tuple(w.v if name == "folded" and valued else w[name] for w in window)
            by_template.setdefault(template, set()).add(x[name])
            by_hash.setdefault(x[name], set()).add(template)
    assert all(len(x) == 1 for x in by_template.values()) and all(len(x) == 1 for x in by_hash.values())
    assert 50 < dense < len(got) - 50


def test_windows_are_made_in_compiled_code(spark, monkeypatch):
    """Lambda functions are interpreted: each goes over all words, so they may not grow with the widths asked for."""
    real, plans = D.stored, []
    monkeypatch.setattr(D, "stored", lambda df, name: (name == "hits" and plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, name))[1])
    words = LONG.split()
    for sizes in ([8], [5, 6, 7, 8]):
        bench = spark.createDataFrame([(n, " ".join(words[:n])) for n in sizes], "item_id long, text string")
        assert {(x.item_id, x.n_windows) for x in contaminated(docs_of(spark, [(1, LONG)]), bench).collect()} == {(n, 1) for n in sizes}
    passes = [p.count("zip_with(") + p.count("transform(") for p in plans]
    assert passes[0] == passes[1] <= 10
