"""Comparison of two samples, in any number of groups at once. Both sides need LEAST defined values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftglass.functions import keyed
from driftglass.operators.sequence import joint_counts

LEAST = 5
# values of a group that are compared as one array; repeats of a block; hashes of a block
TOGETHER, AT_ONCE, CELLS = 200_000, 100, 2_000_000
# ids of a side that a task holds beside the other side's; ids of a chunk; draws of a task
FEW, CHUNK, SLOTS = 4096, 8192, 1 << 20


def two_sides(a: DataFrame, b: DataFrame, **groups: tuple[str, ...]) -> DataFrame:
    """Samples of long facts: those of a on side 'a', repeated for every group of a column that only b has; those of b on
    side 'b'. groups: the column's values; where they aren't given, they are looked up."""
    for column in (c for c in b.columns if c not in a.columns):
        names = groups.get(column) or [r[0] for r in b.select(column).distinct().collect()]  # names of groups
        a = a.withColumn(column, F.explode(F.array(*map(F.lit, names)))) if names else a.limit(0).withColumn(column, F.lit(None).cast("string"))
    return a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))


def compared(samples: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """by, n_a, n_b, auc, power, ks of samples(by, side, value); weight: how often a row counts.

    auc: probability that a value of b exceeds one of a, ties by half; power: twice its distance from a half; ks: greatest
    distance of the two cumulative shares, on whole numbers until the last division.
    """
    gap = F.abs(F.col("cum_a") * F.col("n_b") - F.col("cum_b") * F.col("n_a"))
    beaten = F.col("a") * (2 * (F.col("n_b") - F.col("cum_b")) + F.col("b"))
    out = joint_counts(samples, by, weight).groupBy(*by).agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.sum(beaten).alias("wins"), F.max(gap).alias("gap"))
    pairs, enough = F.col("n_a") * F.col("n_b"), (F.col("n_a") >= LEAST) & (F.col("n_b") >= LEAST)
    out = out.withColumn("auc", F.when(enough, F.col("wins") / (2 * pairs))).withColumn("ks", F.when(enough, F.col("gap") / pairs))
    return out.withColumn("power", 2 * F.abs(F.col("auc") - 0.5)).select(*by, "n_a", "n_b", "auc", "power", "ks", "gap")


def placed(real: DataFrame, made: DataFrame, shared: str) -> DataFrame:
    """real(shared, id, value) as side 'a' and made(cell, id, value) as side 'b', without nulls, each with how many real values of the same
    `shared` lie below its own (under), and at or below it (upto)."""
    other = [F.lit(None).cast(t).alias(c) for c, t in made.dtypes if c not in real.columns]
    rows = real.select("*", *other, F.lit("a").alias("side")).unionByName(made.withColumn("side", F.lit("b"))).where("value IS NOT NULL")
    counts = joint_counts(rows, [shared]).select(shared, "value", (F.col("cum_a") - F.col("a")).alias("under"), F.col("cum_a").alias("upto"))
    return rows.join(counts, [shared, "value"])


def compared_cells(real: DataFrame, made: DataFrame, cell: list[str], shared: str, rows: DataFrame | None = None) -> DataFrame:
    """As `compared`, for every cell of real(shared, value) against made(cell, value), where real is large and is met by all cells: it is
    cumulated once for each `shared`, and a cell is worked out from its made values (runs, whose number is a parameter) and their places. rows: `placed`, if it is known."""
    cells = made.select(*cell).distinct()  # names of cells
    n_a = real.groupBy(shared).agg(F.count("value").alias("n_a"))
    rows = (placed(real.select(shared, "value"), made.select(*cell, "value"), shared) if rows is None else rows).where("side = 'b'")
    rows = rows.join(F.broadcast(n_a), shared, "left").withColumn("n_a", F.coalesce("n_a", F.lit(0))).withColumn("n_b", F.count("*").over(Window.partitionBy(*cell)))
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("value"))  # of equal values the first tells what is below, the last what is up to them
    gap = F.greatest(F.col("under") * F.col("n_b") - (place - 1) * F.col("n_a"), place * F.col("n_a") - F.col("upto") * F.col("n_b"))
    rows = rows.withColumn("gap", gap).groupBy(*cell).agg(F.max("n_b").alias("n_b"), F.sum(F.col("under") + F.col("upto")).alias("wins"), F.max("gap").alias("gap"))
    out = cells.join(rows, cell, "left").join(F.broadcast(n_a), shared, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_a", "n_b", "wins", "gap")})
    pairs, enough = F.col("n_a") * F.col("n_b"), (F.col("n_a") >= LEAST) & (F.col("n_b") >= LEAST)
    out = out.withColumn("auc", F.when(enough, F.col("wins") / (2 * pairs))).withColumn("ks", F.when(enough, F.col("gap") / pairs))
    return out.withColumn("power", 2 * F.abs(F.col("auc") - 0.5)).select(*cell, "n_a", "n_b", "auc", "power", "ks", "gap")


def permutation_test(samples: DataFrame, by: list[str], row_id: list[str], times: int, seed: int, together: int = TOGETHER) -> DataFrame:
    """by, ks, pvalue, null95: labels are dealt anew `times` times, by the order of a keyed hash.

    A permutation deals as many 'a' labels as there are; p counts those whose distance is at least the one found, on whole
    numbers, with one added above and below. Groups of up to `together` values are dealt as arrays, permutations in blocks;
    larger ones row by row. Both deal alike.
    """
    found = compared(samples, by).select(*by, "n_a", "n_b", "ks", "gap")
    return tested(found, null_gaps(samples, by, row_id, times, seed, together), by, times)


def null_gaps(samples: DataFrame, by: list[str], row_id: list[str], times: int, seed: int, together: int = TOGETHER) -> DataFrame:
    """by, null_gap: the distance, in whole numbers, of each permutation."""
    small, large = by_size(samples.where("value IS NOT NULL"), by, together)
    nulls = []
    if small is not None:
        nulls.append(in_blocks(small, by, row_id, times, seed, permuted_gaps, "null_gap long"))
    if large is not None:
        dealt = dealt_labels(large, by, row_id, times, seed)
        nulls.append(compared(dealt, [*by, "perm"]).select(*by, F.col("gap").alias("null_gap")))
    return nulls[0].unionByName(nulls[1]) if len(nulls) > 1 else nulls[0]


def tested(found: DataFrame, null: DataFrame, by: list[str], times: int) -> DataFrame:
    """by, ks, pvalue, null95 of found(by, n_a, n_b, ks, gap) and the permutations' null(by, null_gap)."""
    null_ks = F.when(F.col("ks").isNotNull(), F.col("null_gap") / (F.col("n_a") * F.col("n_b")))
    out = found.join(null, by, "left").groupBy(*by).agg(F.first("ks").alias("ks"), F.count_if(F.col("null_gap") >= F.col("gap")).alias("above"), F.percentile(null_ks, F.lit(0.95)).alias("null95"))
    return out.select(*by, "ks", F.when(F.col("ks").isNotNull(), (F.col("above") + 1) / (times + 1)).alias("pvalue"), "null95")


def dealt_labels(rows: DataFrame, by: list[str], row_id: list[str], times: int, seed: int, perms: DataFrame | None = None) -> DataFrame:
    """by, perm, side, value: labels of rows(by, side, row_id, value) dealt anew `times` times, 'a' to as many as have it, the least by a keyed hash.
    perms(by, perm): the permutations that are wanted, where not all are.

    Hashes are counted in ranges by their first digits. The ranges before the one in which the 'a' end are all 'a', those after it 'b'; only
    that range's own rows, a few thousandths, are put in order."""
    sizes = rows.groupBy(*by).agg(F.count_if(F.col("side") == "a").alias("n_side"))
    rows = rows.select(*by, "side", *row_id, "value")
    rows = rows.join(perms, by) if perms is not None else rows.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    rows = rows.withColumn("hash", F.md5(F.concat_ws("|", F.lit(seed), F.lit("perm"), "perm", "side", *row_id))).withColumn("range", F.substring("hash", 1, 3))
    upto = F.sum("n").over(Window.partitionBy(*by, "perm").orderBy("range"))
    counts = rows.groupBy(*by, "perm", "range").agg(F.count("*").alias("n")).withColumn("upto", upto).join(sizes, by)
    edge = counts.where((F.col("upto") >= F.col("n_side")) & (F.col("upto") - F.col("n") < F.col("n_side")))
    edge = edge.select(*by, "perm", F.col("range").alias("edge"), (F.col("n_side") - F.col("upto") + F.col("n")).alias("left"))  # a row a group and permutation
    rows = rows.join(edge, [*by, "perm"], "left")  # no edge: no 'a' at all
    place = F.row_number().over(Window.partitionBy(*by, "perm").orderBy("hash", "side", *row_id))
    border = rows.where("range = edge").withColumn("dealt", F.when(place <= F.col("left"), "a").otherwise("b"))
    rest = rows.where("edge IS NULL OR range <> edge").withColumn("dealt", F.when(F.col("range") < F.col("edge"), "a").otherwise("b"))
    return border.unionByName(rest).select(*by, "perm", F.col("dealt").alias("side"), "value")


def bootstrap_power(samples: DataFrame, by: list[str], row_id: list[str], times: int, seed: int, together: int = TOGETHER) -> DataFrame:
    """by, ci_lo, ci_hi: 2.5 and 97.5 percent of the power when both sides are drawn anew with replacement.

    Groups of up to `together` values are drawn as arrays, repeats in blocks; larger ones by a join. Both draw alike."""
    small, large = by_size(samples.where("value IS NOT NULL"), by, together)
    powers = []
    if small is not None:
        powers.append(in_blocks(small, by, row_id, times, seed, drawn_powers, "power double", named=False))
    if large is not None:
        rows = large.withColumn("at", F.row_number().over(Window.partitionBy(*by, "side").orderBy(*row_id)) - 1)
        sizes = rows.groupBy(*by, "side").agg(F.count("*").alias("n"))
        draws = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        draws = draws.withColumn("at", keyed.index(F.col("n"), seed, "boot", *by_columns(by), F.col("rep"), F.col("side"), F.col("slot")))
        drawn = draws.join(rows.select(*by, "side", "at", "value"), [*by, "side", "at"]).select(*by, "rep", "side", "value")
        powers.append(compared(drawn, [*by, "rep"]).select(*by, "power"))
    power = powers[0].unionByName(powers[1]) if len(powers) > 1 else powers[0]
    out = power.groupBy(*by).agg(F.percentile("power", F.lit(0.025)).alias("ci_lo"), F.percentile("power", F.lit(0.975)).alias("ci_hi"))
    return out.select(*by, "ci_lo", "ci_hi")


def cell_intervals(real: DataFrame, made: DataFrame, cell: list[str], shared: str, times: int, seed: int, together: int = TOGETHER) -> DataFrame:
    """cell, power, ci_lo, ci_hi: the power of real(shared, id, value) against made(cell, id, value), and 2.5 and 97.5 percent of it when both
    sides are drawn anew with replacement. shared is one of cell's columns, such as the statistic; the others, such as the generator, tell apart what is compared with the same real values.

    A repeat draws ids once for each side, for all cells together, as counts: n draws from n ids in order, by a keyed hash of
    (repeat, side, draw). A cell's wins are sums over the real values, so up to FEW (or `together`) made ids are met by chunks of real ids, each
    with its own counts of every repeat; values that aren't defined count for nothing. More made ids are joined with the counts.
    """
    sides = {"a": real.select(shared, "id", "value"), "b": made.select(*cell, "id", "value")}
    ids = {s: df.select("id").distinct() for s, df in sides.items()}
    n = {s: df.count() for s, df in ids.items()}
    # ranges of ids are numbered apart, then shifted by what stands before them
    ids = {s: numbered(df) if n[s] > together else df.withColumn("at", F.row_number().over(Window.orderBy("id")) - 1) for s, df in ids.items()}
    rows = {s: df.where("value IS NOT NULL").join(F.broadcast(ids[s]) if n[s] <= FEW else ids[s], "id").drop("id") for s, df in sides.items()}
    if n["b"] <= min(FEW, together):
        found = compared_cells(real, made, cell, shared)
        powers = powers_by_chunks(rows["a"], rows["b"], n, cell, shared, times, seed)
    else:
        met = sides["a"].join(sides["b"].select(*cell).distinct(), shared).withColumn("side", F.lit("a")).select(*cell, "side", "value")
        found = compared(met.unionByName(sides["b"].withColumn("side", F.lit("b")).select(*cell, "side", "value")), cell)
        reps = real.sparkSession.range(times).select(F.col("id").cast("int").alias("rep"))
        drawn = {s: reps.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n[s] - 1).cast("long")))).select("rep", keyed.index(F.lit(n[s]), seed, "boot", F.col("rep"), s, F.col("slot")).alias("at")).groupBy("rep", "at").agg(F.count("*").alias("w")) for s in "ab"}
        b = rows["b"].join(drawn["b"], "at").select(*cell, "rep", F.lit("b").alias("side"), "value", "w")
        a = rows["a"].join(drawn["a"], "at").join(rows["b"].select(*cell).distinct(), shared).select(*cell, "rep", F.lit("a").alias("side"), "value", "w")
        powers = compared(a.unionByName(b), [*cell, "rep"], "w").select(*cell, "power")
    out = powers.groupBy(*cell).agg(F.percentile("power", F.lit(0.025)).alias("ci_lo"), F.percentile("power", F.lit(0.975)).alias("ci_hi"))
    return found.select(*cell, "power").join(out, cell, "left").select(*cell, "power", "ci_lo", "ci_hi")


def numbered(ids: DataFrame) -> DataFrame:
    """id, at: the place of each distinct id in order, from 0, without a sort in one task."""
    cuts = ids.repartitionByRange(F.col("id")).groupBy(F.spark_partition_id().alias("part")).agg(F.max("id").alias("top"), F.count("*").alias("n"))
    tops = sorted((r.top, r.n) for r in cuts.collect())  # a row a range
    before, rows = 0, []
    for k, (top, n) in enumerate(tops):
        rows.append((k, tops[k - 1][0] if k else None, top, before))
        before += n
    kind = dict(ids.dtypes)["id"]
    ranges = F.broadcast(ids.sparkSession.createDataFrame(rows, f"part int, above {kind}, top {kind}, before long"))
    met = ids.join(ranges, (F.col("id") <= F.col("top")) & (F.col("above").isNull() | (F.col("id") > F.col("above"))))
    return met.select("id", (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1).alias("at"))


def powers_by_chunks(real: DataFrame, made: DataFrame, n: dict[str, int], cell: list[str], shared: str, times: int, seed: int, chunk: int = CHUNK, slots: int = SLOTS) -> DataFrame:
    """cell, power of each repeat, of real(shared, at, value) and made(cell, at, value), numbered among n ids a side. A task holds the values of `chunk`
    real ids, or `slots` draws of a repeat; a row for each chunk, cell and repeat is summed."""
    spark, other = real.sparkSession, [c for c in cell if c != shared]
    kinds, spread = dict(made.dtypes), int(spark.conf.get("spark.sql.shuffle.partitions"))  # the work on a row isn't small
    chunks, pieces = -(-n["a"] // chunk), max(1, -(-n["a"] // slots))
    own = real.select(F.floor(F.col("at") / chunk).cast("int").alias("chunk"), (F.col("at") % chunk).cast("int").alias("at"), shared, "value", *(F.lit(None).cast(kinds[c]).alias(c) for c in other), F.lit("a").alias("side"))
    every = spark.range(chunks).select(F.col("id").cast("int").alias("chunk"))
    every = every.join(F.broadcast(made)).select("chunk", F.col("at").cast("int").alias("at"), shared, "value", *other, F.lit("b").alias("side"))  # FEW ids
    jobs = spark.range(times * pieces, numPartitions=4 * spread).select((F.col("id") % times).cast("int").alias("rep"), (F.floor(F.col("id") / times) * slots).cast("long").alias("slot"))
    drawn = jobs.mapInArrow(chunk_counts(n["a"], chunk, slots, seed), "chunk int, rep int, width int, held binary")
    dealt = lambda df: df.repartition(4 * spread, "chunk").groupBy("chunk")
    sums = dealt(own.unionByName(every)).cogroup(dealt(drawn))
    sums = sums.applyInArrow(chunk_wins(n, cell, shared, times, chunk, seed), ", ".join(f"{c} {kinds[c]}" for c in cell) + ", rep int, wins long, n_a long, n_b long")
    sums = sums.groupBy(*cell, "rep").agg(F.sum("wins").alias("wins"), F.sum("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    return sums.where((F.col("n_a") >= LEAST) & (F.col("n_b") >= LEAST)).select(*cell, (2 * F.abs(F.col("wins") / (2 * F.col("n_a") * F.col("n_b")) - 0.5)).alias("power"))


def chunk_counts(n: int, chunk: int, slots: int, seed: int):
    """For each repeat and stretch of draws, what falls into each chunk of the n ids: how often each id, or, if that is shorter, the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, slot in zip(batch.column("rep").to_pylist(), batch.column("slot").to_pylist()):
                at = np.sort(keyed.indexes(n, f"{seed}|boot|", rep, rep + 1, "|a|", slot, min(n, slot + slots))[0])
                ends, out = np.searchsorted(at, np.arange(0, n + chunk, chunk)), []
                for k in range(len(ends) - 1):
                    held = at[ends[k] : ends[k + 1]] - k * chunk
                    counts = np.bincount(held, minlength=min(chunk, n - k * chunk))
                    width = np.min_scalar_type(counts.max(initial=0)).itemsize
                    if len(held) and len(counts) * width <= 4 * len(held):
                        out.append((k, rep, width, counts.astype(f"<u{width}").tobytes()))
                    elif len(held):
                        out.append((k, rep, 0, held.astype("<i4").tobytes()))
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=["chunk", "rep", "width", "held"])

    return run


def chunk_wins(n: dict[str, int], cell: list[str], shared: str, times: int, chunk: int, seed: int):
    """What a chunk of the real ids adds to each cell's and repeat's wins and number of real values, and the number of made values."""
    other = [c for c in cell if c != shared]

    def run(rows: pa.Table, drawn: pa.Table) -> pa.Table:
        counts = np.zeros((times, chunk), np.int32)
        for rep, width, held in zip(*(drawn.column(c).to_pylist() for c in ("rep", "width", "held"))):
            found = np.frombuffer(held, f"<u{width}") if width else np.bincount(np.frombuffer(held, "<i4"))
            counts[rep, : len(found)] += found.astype(np.int32)
        at = keyed.indexes(n["b"], f"{seed}|boot|", 0, times, "|b|", 0, n["b"]) + np.arange(times)[:, None] * n["b"]
        made = np.bincount(at.ravel(), minlength=times * n["b"]).reshape(times, -1)
        table, out = rows.to_pandas(), []
        own, every = table[table.side == "a"].sort_values("value"), table[table.side == "b"]
        own = dict(list(own.groupby(shared)))
        for name, cells in every.groupby(shared):
            real = own.get(name, table[:0])
            values, places = real["value"].to_numpy(float), real["at"].to_numpy(int)
            cells = [(key, v["value"].to_numpy(float), v["at"].to_numpy(int)) for key, v in (cells.groupby(other) if other else [((), cells)])]
            for first in range(0, times, AT_ONCE):
                reps = slice(first, min(first + AT_ONCE, times))
                upto = np.zeros((reps.stop - first, len(values) + 1), np.int64)
                np.cumsum(counts[reps][:, places], axis=1, out=upto[:, 1:])
                for key, v, ids in cells:
                    weights = made[reps][:, ids]
                    wins = (weights * (upto[:, np.searchsorted(values, v)] + upto[:, np.searchsorted(values, v, "right")])).sum(axis=1)
                    out.append((dict(zip(other, key)) | {shared: name}, np.arange(first, reps.stop), wins, upto[:, -1], weights.sum(axis=1)))
        names = [pa.array(np.repeat([k[c] for k, *_ in out], [len(x[1]) for x in out]).tolist(), rows.schema.field(c).type) for c in cell]
        numbers = [pa.array(np.concatenate([x[j] for x in out]), t) for j, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64()), (4, pa.int64()))]
        return pa.Table.from_arrays([*names, *numbers], names=[*cell, "rep", "wins", "n_a", "n_b"])

    return run


def by_size(rows: DataFrame, by: list[str], together: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of groups of up to `together` rows, and those of larger groups; None where there are none."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_size"))
    if not (sizes.agg(F.max("_size")).first()[0] or 0) > together:
        return rows, None
    sizes = sizes.withColumn("_large", F.col("_size") > together)
    marked = rows.join(sizes.drop("_size"), by)
    return marked.where("NOT _large").drop("_large"), marked.where("_large").drop("_large")


def in_blocks(rows: DataFrame, by: list[str], row_id: list[str], times: int, seed: int, make, made: str, named: bool = True) -> DataFrame:
    """by and what make(group, first, last, step, known, seed) yields for each of `times` repeats: one group and one block of repeats at a
    time, of which `step` repeats, CELLS hashes, are made at once. Where rows aren't told apart by their names but by their order, named is false, and only values travel.

    Groups with the same rows are dealt to the same task for a block, as their hashes are the same.
    """
    member = F.struct(*row_id, *([F.concat_ws("|", *row_id).alias("_id")] if named else []), "value")
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, member)))
    groups = rows.groupBy(*by).agg(side("a").alias("a"), side("b").alias("b"))
    ids = [F.col(f"{s}._id").alias(f"{s}_ids") for s in "ab"] if named else []
    groups = groups.select(*by, F.concat_ws("|", *by).alias("labels"), *ids, F.col("a.value").alias("a"), F.col("b.value").alias("b"))
    cells = groups.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(times - 1), F.lit(AT_ONCE))))
    same = F.xxhash64("a_ids", "b_ids") if named else F.xxhash64("labels")
    spread = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # blocks are few and the work on them isn't small
    cells = cells.repartition(spread, "first", same).sortWithinPartitions("first", same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for i in range(len(batch)):
                cell = {c: batch.column(c)[i] for c in ("labels", "a", "b", *(("a_ids", "b_ids") if named else ()))}
                first, size = batch.column("first")[i].as_py(), max(1, len(cell["a"]) + len(cell["b"]))
                for values in make(cell, first, min(first + AT_ONCE, times), max(1, CELLS // size), known, seed):
                    at = pa.array(np.full(len(values), i))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in by), pa.array(values)], names=[*by, made.split()[0]])

    kinds = dict(rows.dtypes)
    return cells.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", " + made)


def values_of(cell: dict, side: str) -> np.ndarray:
    return cell[side].values.to_numpy(zero_copy_only=False)


def label_hashes(names: list[bytes], first: int, last: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the hash that orders names (side and id) in each permutation from first to last - 1."""
    halves = np.empty((2, last - first, len(names)), np.uint64)
    sizes = np.fromiter(map(len, names), int, len(names))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        tails = np.frombuffer(b"".join(names[k] for k in at), np.uint8).reshape(len(at), size)
        for k, words in keyed.hashes(f"{seed}|perm|", first, last, "|", tails):
            for half, (left, right) in zip(halves, (words[:2], words[2:])):
                half[k - first : k - first + len(left), at] = left.astype(np.uint64) << np.uint64(32) | right
    return halves[0], halves[1]


def permuted_gaps(cell: dict, first: int, last: int, step: int, known: dict, seed: int) -> Iterator[np.ndarray]:
    """The greatest distance (in whole numbers) of each permutation from first to last - 1."""
    a, b = values_of(cell, "a"), values_of(cell, "b")
    values, n = np.append(a, b), len(a) + len(b)
    names = [f"{s}|{x}".encode() for s in "ab" for x in cell[f"{s}_ids"].as_py()]
    if known.get("at") != (first, names):  # statistics of the same windows share their labels
        known.update(at=(first, names), dealt=np.zeros((last - first, n), bool))
        for k in range(first, last, step):
            high, low = label_hashes(names, k, min(k + step, last), seed)
            np.put_along_axis(known["dealt"][k - first : k - first + step], np.lexsort((low, high), axis=1)[:, : len(a)], True, axis=1)
    place = np.argsort(values, kind="stable")
    ends = np.append(values[place][1:] != values[place][:-1], True)[:n]
    for k in range(0, last - first, step):
        below = np.cumsum(known["dealt"][k : k + step, place], axis=1, dtype=np.int64)[:, ends]
        yield np.abs(below * n - (np.flatnonzero(ends) + 1) * len(a)).max(axis=1, initial=0)


def drawn_powers(cell: dict, first: int, last: int, step: int, known: dict, seed: int) -> Iterator[np.ndarray]:
    """The power of each repeat from first to last - 1; none if a side has too few values."""
    sides, labels = (values_of(cell, "a"), values_of(cell, "b")), cell["labels"].as_py()
    if min(map(len, sides)) < LEAST:
        return
    levels = np.unique(np.append(*sides))
    at_level, pairs = [np.searchsorted(levels, values) for values in sides], len(sides[0]) * len(sides[1])
    for k in range(first, last, step):
        reps, counts = min(k + step, last) - k, []
        for name, level in zip("ab", at_level):
            at = keyed.indexes(len(level), f"{seed}|boot|{labels}|", k, k + reps, f"|{name}|", 0, len(level))
            at = level[at] + np.arange(reps)[:, None] * len(levels)
            counts.append(np.bincount(at.ravel(), minlength=reps * len(levels)).reshape(reps, -1))
        a, b = counts
        wins = (a * (2 * (len(sides[1]) - np.cumsum(b, axis=1)) + b)).sum(axis=1)
        yield 2 * np.abs(wins / (2 * pairs) - 0.5)


def by_columns(by: list[str]) -> list:
    return [F.col(c) for c in by]
