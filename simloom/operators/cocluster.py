"""Co-clustering of the sample-by-bit matrix under a description-length cost.

State: row labels r(vid, rg), column labels c(bit, cg) over all bits, k, l. Block counts, group sizes and costs are k x l numbers and live on
the driver; labels and postings stay distributed. A pass moves all rows (columns) against frozen blocks and relabels without empty groups.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simloom.common import settled
from simloom.functions.scalar import entropy_bits, log_star
from simloom.operators.fingerprint import with_vids


@dataclass
class State:
    r: DataFrame
    c: DataFrame
    k: int
    l: int  # noqa: E741
    cost: float = math.inf
    #: Block counts and group sizes, once they are known.
    g: np.ndarray | None = None
    rows: np.ndarray | None = None
    cols: np.ndarray | None = None


def random_cuts(n: int, groups: int, seed: int) -> list[int]:
    """One cut anywhere in each stripe of n // groups items; an item's label is the number of cuts at or below it, so a cut at 0 leaves the
    first group empty."""
    rng, stripe = np.random.default_rng(seed), n // groups
    return [int(rng.integers(i * stripe, (i + 1) * stripe)) for i in range(groups - 1)]


def even_cuts(n: int, groups: int) -> list[int]:
    return [n * i // groups for i in range(1, groups)]


def cut_label(index: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are at or below ``index``, however many there are."""
    cuts = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def label(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, x.to_numpy(np.int64), side="right").astype(np.int32))

    return label(index.cast("long"))


def initial(spark: SparkSession, vids: DataFrame, fp_bits: int, k: int, l: int, seed: int | None = 0) -> State:  # noqa: E741
    """Contiguous groups of dense vids from 0 and of bits; seed None: even cuts."""
    n = vids.count()
    if not 1 <= k <= n or not 1 <= l <= fp_bits:
        raise ValueError(f"{k} x {l} groups of {n} samples and {fp_bits} bits")
    rows, cols = (even_cuts(n, k), even_cuts(fp_bits, l)) if seed is None else (random_cuts(n, k, seed), random_cuts(fp_bits, l, seed + 1))
    r = vids.select("vid", cut_label(F.col("vid"), rows).alias("rg"))
    c = spark.range(fp_bits).select(F.col("id").cast("int").alias("bit"), cut_label(F.col("id"), cols).alias("cg"))
    return State(r, c, k, l)


def shuffled(rows: DataFrame) -> DataFrame:
    """For a join with a table of a row for each sample: a broadcast would pass it through the driver, in each pass anew."""
    return rows.hint("merge")


def block_counts(postings: DataFrame, r: DataFrame, c: DataFrame) -> DataFrame:
    """rg, cg and n1, the ones of each block that has any."""
    return postings.join(shuffled(r), "vid").join(c, "bit").groupBy("rg", "cg").agg(F.count("*").alias("n1"))


def line_statistics(postings: DataFrame, labels: DataFrame, item: str, by: str, group: str) -> DataFrame:
    """Ones of each item (row) by group of the other side: item, group and n. Groups without ones are left out."""
    return postings.join(shuffled(labels) if by == "vid" else labels, by).groupBy(item, group).agg(F.count("*").alias("n"))


def sizes(labels: DataFrame, group: str, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for g, m in labels.groupBy(group).count().collect():
        out[g] = m
    return out


def matrix(blocks: DataFrame, k: int, l: int) -> np.ndarray:  # noqa: E741
    g = np.zeros((k, l), np.int64)
    for x in blocks.collect():
        g[x.rg, x.cg] = x.n1
    return g


def code_lengths(n1: np.ndarray, total: np.ndarray) -> np.ndarray:
    n1, n0 = n1.astype(float), (total - n1).astype(float)
    both = (n1 > 0) & (n0 > 0)
    a, b, n = np.where(both, n1, 1), np.where(both, n0, 1), np.where(both, n1 + n0, 1)
    return np.where(both, a * np.log2(n / a) + b * np.log2(n / b), 0.0)


def best_groups(current: np.ndarray, stats: np.ndarray, g: np.ndarray, own: np.ndarray, other: np.ndarray, ties: str = "lowest") -> np.ndarray:
    """The group of least change of code length for each item. stats [items, l]; g [k, l]; own, other: group sizes.

    ties: lowest label, or current (stay where a move gains nothing, else the first).
    """
    before = code_lengths(g, np.outer(own, other)).sum(1)
    left = code_lengths(g[current] - stats, np.maximum(own[current] - 1, 0)[:, None] * other[None, :]).sum(1) - before[current]
    change = np.empty((len(current), len(g)))
    for i in range(len(g)):
        change[:, i] = left + (code_lengths(g[i] + stats, (own[i] + 1) * other[None, :]).sum(1) - before[i])
    rows = np.arange(len(current))
    change[rows, current] = 0.0
    change = np.round(change, 6)  # sums that differ by their order alone are ties
    best = change.argmin(1)
    return best if ties == "lowest" else np.where(change[rows, best] < 0, best, current)


def move(postings: DataFrame, labels: DataFrame, others: DataFrame, g: np.ndarray, own: np.ndarray, other: np.ndarray, item: str, by: str, mine: str, theirs: str, ties: str) -> DataFrame:
    """Labels after one pass against frozen blocks. Items without a one take part too: those of one label decide once, on the driver."""
    width = len(other)
    counts = line_statistics(postings, others, item, by, theirs).groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct(theirs, "n"))).alias("m"))
    wide = labels.join(shuffled(counts), item).select(item, mine, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("bigint")).alias("stats"))

    @F.pandas_udf("int")
    def choose(current: pd.Series, stats: pd.Series) -> pd.Series:
        if not len(current):
            return pd.Series([], dtype="int32")
        return pd.Series(best_groups(current.to_numpy(np.int64), np.stack(stats.to_numpy()), g, own, other, ties).astype(np.int32))

    decided = wide.select(item, choose(mine, "stats").alias("new"))
    held = np.flatnonzero(own)
    empty = best_groups(held, np.zeros((len(held), width), np.int64), g, own, other, ties)
    table = labels.sparkSession.createDataFrame([(int(x), int(y)) for x, y in zip(held, empty)] or [(-1, -1)], f"{mine} int, without int")
    return labels.join(F.broadcast(table), mine, "left").join(shuffled(decided), item, "left").select(item, F.coalesce("new", "without").alias(mine))


def blocks(postings: DataFrame, s: State) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block counts, row group sizes and column group sizes of a state, each counted once."""
    if s.g is None:
        s.g = matrix(block_counts(postings, s.r, s.c), s.k, s.l)
    if s.rows is None:
        s.rows = sizes(s.r, "rg", s.k)
    if s.cols is None:
        s.cols = sizes(s.c, "cg", s.l)
    return s.g, s.rows, s.cols


def without_empty(labels: DataFrame, group: str, n: int) -> tuple[DataFrame, np.ndarray]:
    """Labels renumbered in order without empty groups, and the sizes of those that remain."""
    counts = sizes(labels, group, n)
    used = np.flatnonzero(counts)
    if len(used) < n:
        table = labels.sparkSession.createDataFrame([(int(x), i) for i, x in enumerate(used)], f"{group} int, now int")
        labels = labels.join(F.broadcast(table), group).drop(group).withColumnRenamed("now", group)
    return labels, counts[used]


def row_pass(postings: DataFrame, s: State, ties: str = "lowest") -> State:
    g, own, other = blocks(postings, s)
    r, rows = without_empty(settled(move(postings, s.r, s.c, g, own, other, "vid", "bit", "rg", "cg", ties)), "rg", s.k)
    return State(r, s.c, len(rows), s.l, rows=rows, cols=other)


def column_pass(postings: DataFrame, s: State, ties: str = "lowest") -> State:
    g, own, other = blocks(postings, s)
    c, cols = without_empty(settled(move(postings, s.c, s.r, g.T, other, own, "bit", "vid", "cg", "rg", ties)), "cg", s.l)
    return State(s.r, c, s.k, len(cols), rows=own, cols=cols)


def description_cost(g: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> float:
    """Bits for the numbers of groups, their sizes, and the blocks' counts and contents."""
    cost = float(log_star(len(rows)) + log_star(len(cols)))
    for side in (rows, cols):
        ordered = sorted(side.tolist(), reverse=True)
        cost += sum(math.ceil(math.log2(max(sum(ordered[i:]) - (len(ordered) - 1) + i, 1))) for i in range(len(ordered) - 1))
    for i in range(len(rows)):
        for j in range(len(cols)):
            area = int(rows[i]) * int(cols[j])
            cost += math.ceil(math.log2(area + 1)) + entropy_bits(int(g[i, j]), area - int(g[i, j]))
    return cost


def content_cost(g: np.ndarray, rows: np.ndarray, cols: np.ndarray, base: float = 2.0) -> float:
    """Entropy of the blocks alone, in bits or another base's units."""
    return float(code_lengths(g, np.outer(rows, cols)).sum()) / math.log2(base)


def cost_of(postings: DataFrame, s: State, kind: str = "description") -> float:
    g, rows, cols = blocks(postings, s)
    return description_cost(g, rows, cols) if kind == "description" else content_cost(g, rows, cols, math.e)


def refine(postings: DataFrame, s: State, factor: float = 1.0, ties: str = "lowest", kind: str = "description") -> tuple[State, float]:
    """Row and column passes until the cost is not below ``factor`` times the last. The state is that of the last pass; also the least cost seen."""
    before, postings = math.inf, settled(postings)
    while True:
        s = column_pass(postings, row_pass(postings, s, ties), ties)
        s.cost = cost_of(postings, s, kind)
        if s.cost >= before * factor:
            break
        before = s.cost
    return s, min(before, s.cost)


def split(postings: DataFrame, s: State, side: str, n: int) -> State:
    """The n groups of highest code length (lower label first) give the first half of their members, by id, to new groups at the end."""
    g, rows, cols = blocks(postings, s)
    lengths = code_lengths(g, np.outer(rows, cols)).sum(1 if side == "row" else 0)
    top = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))[:n]
    labels, item, group, old, size = (s.r, "vid", "rg", s.k, rows) if side == "row" else (s.c, "bit", "cg", s.l, cols)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(item))
    new = F.col(group)
    for i, x in enumerate(top):
        new = F.when((F.col(group) == x) & (F.col("place") <= int(size[x]) // 2), old + i).otherwise(new)
    moved = settled(labels.withColumn("place", rank).select(item, new.cast("int").alias(group)))
    return State(moved, s.c, s.k + len(top), s.l) if side == "row" else State(s.r, moved, s.k, s.l + len(top))


def search(postings: DataFrame, s: State) -> State:
    """Grows the groups by splits: rows first; a gain doubles the number of splits, a loss halves it and, at one, changes sides;
    it ends when both sides have failed one after the other."""
    postings = settled(postings)
    best, side, n, failed, doubled_too_far = None, "row", 1, {"row": False, "col": False}, False
    while True:
        s, _ = refine(postings, s)
        other = "col" if side == "row" else "row"
        if best is None:
            best = s
        elif s.cost < best.cost:
            best, failed[other] = s, False
            groups = best.k if side == "row" else best.l
            if not doubled_too_far and 2 * n <= groups:
                n *= 2
        elif n == 1:
            doubled_too_far, failed[side] = False, True
            if failed[other]:
                break
            side = other
        else:
            doubled_too_far, n = True, n // 2
        s = split(postings, best, side, n)
    return best


def grid_search(spark: SparkSession, postings: DataFrame, vids: DataFrame, fp_bits: int, k: int, l: int, seed: int = 0) -> State:  # noqa: E741
    """The other search: each time new contiguous groups, rows by eight more and columns by twice as many than were asked for last, until both
    have failed one after the other. More groups than there are items fail."""
    n, postings = vids.count(), settled(postings)
    asked, side, stopped, best, tries = {"row": k, "col": l}, "row", {"row": False, "col": False}, None, 0
    while True:
        s = None
        if asked["row"] <= n and asked["col"] <= fp_bits or best is None:
            s, cost = refine(postings, initial(spark, vids, fp_bits, asked["row"], asked["col"], seed + 2 * tries), 0.999, "current", "content")
            tries += 1
        other = "col" if side == "row" else "row"
        if s is not None and (best is None or cost < best.cost):
            stopped[other] = stopped[other] and best is None
            best = s
            best.cost = cost
        else:
            asked[side] = asked[side] - 8 if side == "row" else asked[side] // 2
            stopped[side] = True
            if stopped[other]:
                return best
            side = other
        asked[side] = asked[side] + 8 if side == "row" else asked[side] * 2


def cocluster(fps: DataFrame, fp_bits: int, k: int, l: int, seed: int | None = 0, how: str = "split", id_col: str = "vid") -> tuple[DataFrame, DataFrame, State]:  # noqa: E741
    """From fingerprints (of samples, or of a stored matrix) to co-clusters: ids with their dense vid and row group, postings, and the state.
    how: split (grows the best state by splits) or grid (starts anew with more groups)."""
    spark = fps.sparkSession
    ids = settled(with_vids(fps.select(F.col(id_col).alias("id")), "id", 0))
    posts = settled(fps.select(F.col(id_col).alias("id"), F.explode("bits").alias("bit")).join(ids, "id").select("vid", "bit"))
    vids = ids.select("vid")
    s = search(posts, initial(spark, vids, fp_bits, k, l, seed)) if how == "split" else grid_search(spark, posts, vids, fp_bits, k, l, seed or 0)
    return ids.join(s.r, "vid").select("id", "vid", "rg"), posts, s


def permutation(g: np.ndarray, rows: np.ndarray, cols: np.ndarray, dense: float = 0.95) -> tuple[list[int], list[int]]:
    """New label of each row and column group: rows by the area of their dense blocks; columns by density in the first row group, those
    empty there by the sum of their densities. Equals by label."""
    area = np.outer(rows, cols)
    density = np.divide(g.astype(np.float32), area.astype(np.float32), out=np.zeros(g.shape, np.float32), where=area > 0)
    weight = np.where(density > dense, area, 0).sum(1)
    row_order = sorted(range(len(rows)), key=lambda i: (-weight[i], i))
    first = density[row_order[0]]
    column_order = sorted(range(len(cols)), key=lambda j: (first[j] == 0, -float(first[j] if first[j] > 0 else density[:, j].sum()), j))
    return [row_order.index(i) for i in range(len(rows))], [column_order.index(j) for j in range(len(cols))]


def permute(postings: DataFrame, s: State) -> State:
    rows, cols = permutation(*blocks(postings, s))
    at = lambda column, new: F.element_at(F.array(*map(F.lit, new)), F.col(column) + 1)
    return State(s.r.withColumn("rg", at("rg", rows)), s.c.withColumn("cg", at("cg", cols)), s.k, s.l, s.cost)


def dominant_and_others(fps: DataFrame, r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of the first row group and of the others; ids are kept, and the rows that are elsewhere stay as empty ones."""
    both = fps.join(r, "vid")
    empty = F.array().cast("array<int>")
    keep = lambda yes: both.select("vid", F.when(yes, F.col("bits")).otherwise(empty).alias("bits"))
    return keep(F.col("rg") == 0), keep(F.col("rg") != 0)


def merge(a: State, b: State, bits_a: DataFrame, bits_b: DataFrame) -> tuple[DataFrame, State]:
    """Result b of the last row group of result a, put in its place: united postings, row labels, and column labels as ranks of pairs."""
    united = bits_a.select("vid", "bit").union(bits_b.select("vid", "bit")).distinct()
    label = F.when(F.col("ra") < a.k - 1, F.col("ra")).when(F.col("rb") < b.k - 1, F.col("rb") + a.k - 1).otherwise(a.k + b.k - 2)
    r = a.r.toDF("vid", "ra").join(b.r.toDF("vid", "rb"), "vid").select("vid", label.cast("int").alias("rg"))
    pairs = a.c.toDF("bit", "ca").join(b.c.toDF("bit", "cb"), "bit")
    used = sorted((x.ca, x.cb) for x in pairs.select("ca", "cb").distinct().collect())
    table = a.r.sparkSession.createDataFrame([(x, y, i) for i, (x, y) in enumerate(used)], "ca int, cb int, cg int")
    return united, State(r, pairs.join(F.broadcast(table), ["ca", "cb"]).select("bit", "cg"), a.k + b.k - 1, len(used))


def coordinates(postings: DataFrame, s: State) -> DataFrame:
    """Dot-plot place of every one: x and y in group order with a gap of one between groups, y from the bottom."""
    _, rows, cols = blocks(postings, s)
    offset = lambda n: (np.concatenate([[0], np.cumsum(n)[:-1]]) + np.arange(len(n))).tolist()
    at = lambda group, n: F.element_at(F.array(*map(F.lit, offset(n))), F.col(group) + 1)
    y = s.r.withColumn("y", at("rg", rows) + F.row_number().over(Window.partitionBy("rg").orderBy("vid")) - 1)
    x = s.c.withColumn("x", at("cg", cols) + F.row_number().over(Window.partitionBy("cg").orderBy("bit")) - 1)
    top = int(rows.sum()) + len(rows) - 2
    return postings.join(y, "vid").join(x, "bit").select("vid", "bit", F.col("x").cast("long").alias("x"), (F.lit(top) - F.col("y")).cast("long").alias("y"))


def row_group_listing(r: DataFrame, names: DataFrame) -> DataFrame:
    rows = r.join(names, "vid").groupBy("rg").agg(F.array_sort(F.collect_list(F.struct("vid", "name"))).alias("x"))
    return rows.select("rg", F.array_join(F.transform("x", lambda v: v["name"].cast("string")), " ").alias("names"))


def feature_listing(winnowed: DataFrame, c: DataFrame, vid: int, fp_bits: int, base: int = 0) -> DataFrame:
    """Features of one sample by column group: cg, address, hash in hex, and bit. winnowed: vid, pos, hash."""
    own = winnowed.where(F.col("vid") == vid).withColumn("bit", F.col("hash").bitwiseAND(F.lit(fp_bits - 1).cast("bigint")).cast("int"))
    return own.join(c, "bit").select("cg", (F.col("pos") + base).alias("address"), F.lower(F.hex("hash")).alias("shred"), "bit")
