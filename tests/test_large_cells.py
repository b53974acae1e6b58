"""Comparisons of very large samples: hashes many at once, few copies of a group, and sums of parts, all as in plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftglass.functions import keyed
from driftglass.operators import twosample


def test_hashes_of_many_strings_are_md5(spark):
    tails = np.array([[48 + k // 10, 48 + k % 10] for k in range(30)], np.uint8)
    for prefix in ("", "ab|", "x" * 52, "x" * 55, "x" * 64, "x" * 130):  # tails within a block, across its end, in the next
        for at, words in keyed.hashes(prefix, 8, 12, "|", tails):
            for r in range(len(words[0])):
                got = ["".join(f"{int(w[r, k]):08x}" for w in words) for k in range(30)]
                assert got == [hashlib.md5(f"{prefix}{at + r}|{k:02d}".encode()).hexdigest() for k in range(30)]
    keys = spark.range(4).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(149))).alias("slot"))
    want = keys.select("rep", "slot", keyed.index(F.lit(150), 7, "boot", "g", F.col("rep"), "a", F.col("slot")).alias("at")).orderBy("rep", "slot").collect()
    assert keyed.indexes(150, "7|boot|g|", 0, 4, "|a|", 0, 150).ravel().tolist() == [r["at"] for r in want]


def test_a_large_group_is_copied_for_blocks_of_repeats_only(spark, monkeypatch):
    monkeypatch.setattr(twosample, "CELLS", 10)  # as for a group with many more values than a repeat may hash at once
    rows = spark.createDataFrame([("g", s, k, float(k)) for s in "ab" for k in range(20)], "g string, side string, k long, value double")

    def copies(cell, first, last, step, known, seed):
        yield np.array([float(last - first)])

    got = [r.power for r in twosample.in_blocks(rows, ["g"], ["k"], 250, 1, copies, "power double", named=False).collect()]
    assert sorted(got) == [50, 100, 100]


def cells(spark, seed, n_real=400, n_made=9):
    g = np.random.default_rng(seed)
    real = [(s, f"w-{k}", None if (s, k % 7) == ("y", 3) else float(v)) for s in "xy" for k, v in enumerate(g.normal(size=n_real).round(1))]
    made = [(s, m, f"{m}-{k}", None if (s, m, k) == ("y", "q", 2) else float(v)) for s in "xy" for m in ("p", "q") for k, v in enumerate(g.normal(0.3, 1, n_made).round(1))]
    made += [("none", "p", f"p-{k}", 1.0) for k in range(6)] + [("x", "few", "few-1", 0.2)]
    a, b = spark.createDataFrame(real, "stat string, id string, value double"), spark.createDataFrame(made, "stat string, generator string, id string, value double")
    return a.repartition(3), b.repartition(3)


def rows_of(df):
    return {(r.stat, r.generator): tuple(None if x is None else round(x, 12) for x in r[2:]) for r in df.collect()}


def test_cells_that_share_their_real_values_compare_alike(spark):
    a, b = cells(spark, 1)
    got = rows_of(twosample.compared_cells(a, b, ["stat", "generator"], "stat"))
    sides = a.join(b.select("stat", "generator").distinct(), "stat").withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    assert got == rows_of(twosample.compared(sides, ["stat", "generator"])) and got["x", "few"][2] is None and got["none", "p"][0] == 0


@pytest.mark.parametrize(("chunk", "slots"), [(64, 100), (7, 1000)])
def test_intervals_by_chunks(spark, monkeypatch, chunk, slots):
    a, b = cells(spark, 2)
    cell = ["stat", "generator"]
    made = b.select(*cell, F.regexp_replace("id", ".*-", "").alias("id"), "value")
    want = rows_of(twosample.cell_intervals(a, made, cell, "stat", 130, 5, together=3))  # row by row
    by_chunks = twosample.powers_by_chunks
    monkeypatch.setattr(twosample, "powers_by_chunks", lambda *args: by_chunks(*args, chunk, slots))
    assert rows_of(twosample.cell_intervals(a, made, cell, "stat", 130, 5)) == want
    a, b = cells(spark, 3, n_real=3)  # repeats may draw too few values
    assert rows_of(twosample.cell_intervals(a, b, cell, "stat", 20, 5)) == rows_of(twosample.cell_intervals(a, b, cell, "stat", 20, 5, together=2))


@pytest.mark.parametrize(("most", "slack"), [(1.0, 6), (1.0, -2), (0.0, 6)])  # dealt as lists; many lists too short; dealt as arrays
def test_few_made_values_are_dealt_as_lists(spark, monkeypatch, most, slack):
    from driftglass.operators import cells as shared_cells

    monkeypatch.setattr(shared_cells, "RARE", most)
    monkeypatch.setattr(shared_cells, "share", lambda n_a, n_b: min(1.0, (n_b + slack) / (n_a + n_b)))
    monkeypatch.setattr(twosample, "CELLS", 900)
    a, b = cells(spark, 4)
    cell = ["stat", "generator"]
    sides = a.join(b.select(*cell).distinct(), "stat").withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    want = rows_of(twosample.permutation_test(sides, cell, ["id"], 47, 5))
    assert rows_of(shared_cells.permutation_test(a, b, cell, "stat", 47, 5)) == want


def test_worst_cases_meet_the_real_values_without_copies(spark, monkeypatch):
    from driftglass.operators import reports
    from driftglass.plans import catalogue

    a, b = cells(spark, 6)
    a, b, cell = a.where("stat <> 'none'").cache(), b.where("stat <> 'none' AND generator <> 'few'").cache(), ["stat", "generator"]
    copies = []
    two_sides = twosample.two_sides
    monkeypatch.setattr(twosample, "two_sides", lambda *args, **named: copies.append(1) or two_sides(*args, **named))
    monkeypatch.setattr(catalogue, "fitted_sides", lambda spark, d: (a, b))
    monkeypatch.setattr(catalogue, "long_of", lambda spark, d, stride=250: a)
    monkeypatch.setattr(catalogue, "BOOTSTRAPS", 40)
    got = {r.stat: r.asDict() for r in catalogue.worst_case_table(spark, "").collect()}
    assert not copies and set(got) == {"x", "y"}  # each generator had its copy of all real values before
    sides = two_sides(a, b, generator=("p", "q"))
    worst = reports.worst_cases(twosample.compared(sides, cell))
    want = worst.join(twosample.bootstrap_power(sides.join(worst.select(cell), cell), cell, ["id"], 40, catalogue.sql.SEED), cell)
    for r in want.collect():
        mine = got[r.stat]
        assert (mine["generator"], mine["power"], mine["ci_lo"], mine["ci_hi"]) == (r.generator, *(pytest.approx(x, abs=1e-6) for x in (r.power, r.ci_lo, r.ci_hi)))
        assert mine["power_apart"] == pytest.approx(r.power, abs=1e-6)
