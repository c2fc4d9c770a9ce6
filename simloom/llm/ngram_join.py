"""N-gram Jaccard join: size-aware heavy-light set similarity join, and the components of its links.

A document's set holds the 64-bit hashes of its distinct ``k``-word shingles (A-Z lower-cased, words split at
ASCII white space; with fewer words the whole sequence is one shingle). Two sets of Jaccard similarity ``t``
or more share at least ceil(t n) members of either, so under one global order they share at least ``c``
members of their first n - ceil(t n) + c.

* Light sets (up to ``boundary`` members) enumerate all 2-subsets of that prefix with c = 2 as join keys.
* Heavy sets put the prefix with c = 1 into inverted lists, which heavy sets and the light sets within reach of
  their sizes scan.
* The boundary is the size of least cost: keys written plus mean list length for each list scanned, from the
  exact size histogram.

The order is rarest first by a count sketch of all shingles of all rows (any order is exact; this one keeps
shared passages out of prefixes): a shingle's level by the sketch in the high bits, its hash in the others. Equal
sets are one class from the start. A key's places in two sets bound what they share, so pairs that meet late in
their prefixes are not joined. Of a candidate pair the two prefixes alone show how many members up to the lesser of their
ends are not shared, which rules out almost all pairs that are not similar before any whole set is moved. Each key links its members to two
centres of the key first; only members that are then still in different components are compared: those of crowded keys
block by block, at the key of most members first and then at the others that members from different such keys meet at, those of
small keys pair by pair. A block is bounded in sets and in their members. Every link is verified by exact intersection.

Defined results: null, empty and white-space-only texts have no shingles and are linked with nothing; repeated
rows are one class; repeated ids count as one document for links; an empty table gives no rows; other columns
are never read. Null ids are left as they are, linked with nothing.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm.common import broadcast_if, durable, give_back, in_arrow, read_table
from simloom.operators.clustering import components

BASE, SLOTS, CHUNK = 0x9E3779B97F4A7C15, 1 << 22, 1 << 16
CROWD, BLOCK, BLOCK_MEMBERS = 64, 512, 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes of many texts at once, in numpy, block by block of about ``block`` bytes. A longer text is hashed piece by
    piece: its words are put together where a piece cuts them, and its shingles are made in runs."""

    def __init__(self, k: int, block: int = 1 << 18):
        self.k, self.block = k, block
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.full(block + 1, BASE, np.uint64))
            self.inverse = np.cumprod(np.full(block + 1, pow(BASE, -1, 1 << 64), np.uint64))
            self.factors = np.cumprod(np.full(k, 0xD6E8FEB86659FD93, np.uint64))

    def words(self, raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word of a block the sum of its bytes times powers, its length and its start. first: where a text begins."""
        gap = SPACE[raw]
        before = np.empty(len(raw), bool)
        before[0], before[1:] = True, gap[:-1]
        before[first[first < len(raw)]] = True
        starts = np.flatnonzero(before & ~gap)
        after = np.empty(len(raw), bool)
        after[-1], after[:-1] = True, gap[1:]
        after[first[(first > 0) & (first <= len(raw))] - 1] = True
        ends = np.flatnonzero(after & ~gap) + 1
        with np.errstate(over="ignore"):
            run = np.concatenate([[np.uint64(0)], np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)])])
            return (run[ends] - run[starts]) * self.inverse[starts], ends - starts, starts

    def grams(self, words: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            n = max(len(words) - self.k + 1, 0)
            return mixed(sum(words[j : j + n] * self.factors[j] for j in range(self.k))) if n else np.zeros(0, np.uint64)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        out: list[np.ndarray] = []
        a = 0
        while a < len(texts):
            if len(texts[a]) > self.block:
                out.append(self._long(texts[a]))
                a += 1
                continue
            z, size = a, 0
            while z < len(texts) and size + len(texts[z]) <= self.block:
                size += len(texts[z])
                z += 1
            out += self._block(texts[a:z])
            a = z
        return out

    def _short(self, words: np.ndarray) -> np.ndarray:
        """The one shingle of a text of fewer than ``k`` words."""
        with np.errstate(over="ignore"):
            return mixed((words * self.factors[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words)) * np.uint64(BASE))[None] if len(words) else np.zeros(0, np.uint64)

    def _block(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        if not len(raw):
            return [np.zeros(0, np.uint64) for _ in texts]
        edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        sums, lengths, starts = self.words(raw, edges[:-1])
        words = mixed(sums + lengths.astype(np.uint64))
        cut, grams = np.searchsorted(starts, edges), self.grams(words)
        return [np.unique(grams[a : z - self.k + 1]) if z - a >= self.k else self._short(words[a:z]) for a, z in zip(cut[:-1], cut[1:])]

    def _long(self, text: bytes) -> np.ndarray:
        sums, lengths, joined = [], [], False
        for a in range(0, len(text), self.block):
            raw = np.frombuffer(text, np.uint8, min(self.block, len(text) - a), a)
            s, n, starts = self.words(raw, np.zeros(1, np.int64))
            if joined and len(starts) and starts[0] == 0:
                with np.errstate(over="ignore"):
                    sums[-1][-1:] += np.uint64(pow(BASE, int(lengths[-1][-1]), 1 << 64)) * s[:1]
                lengths[-1][-1] += n[0]
                s, n = s[1:], n[1:]
            if len(s):
                sums.append(s)
                lengths.append(n)
            joined = not SPACE[raw[-1]]
        if not sums:
            return np.zeros(0, np.uint64)
        words = mixed(np.concatenate(sums) + np.concatenate(lengths).astype(np.uint64))
        if len(words) < self.k:
            return self._short(words)
        runs = [np.unique(self.grams(words[a : a + self.block + self.k - 1])) for a in range(0, len(words) - self.k + 1, self.block)]
        return np.unique(np.concatenate(runs))


def raw_texts(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))


def least_shared(n: np.ndarray | int, per_cent: int):
    """ceil(t n) in integers."""
    return -(-n * per_cent // 100)


def planes(counts: np.ndarray) -> bytes:
    """32-bit counts compressed by planes of bytes; small counts leave three of four planes empty."""
    return zlib.compress(np.ascontiguousarray(counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def from_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def survey(docs: DataFrame, k: int) -> tuple[DataFrame, dict[int, int], np.ndarray]:
    """id, n and the set's fingerprint (a, b) of every row, written out; exact counts of set sizes; and a count sketch of every row's
    shingles, of ``SLOTS`` slots at any input size.

    Partitions send their sketches in compressed pieces, and tasks add up the same piece of all partitions.
    """

    def local(batches):
        shingler, slots, sizes = Shingler(k), np.zeros(SLOTS, np.uint32), {}
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                sets = shingler.sets(raw_texts(part.column(1)))
                for s in sets:
                    sizes[len(s)] = sizes.get(len(s), 0) + 1
                np.add.at(slots, np.concatenate(sets) & np.uint64(SLOTS - 1), 1)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary()), part.column(0).cast(pa.int64()), *described(sets)], names)
        packed = np.array(sorted(sizes.items()), np.int64).tobytes()
        rows = [(i, planes(slots[i * CHUNK : (i + 1) * CHUNK])) for i in range(SLOTS // CHUNK)] + [(-1, zlib.compress(packed))]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary()), *(pa.nulls(len(rows), pa.int64()) for _ in range(4))], names)

    def total(pdf):
        piece = int(pdf["piece"].iloc[0])
        if piece >= 0:
            add = sum(from_planes(x).astype(np.uint64) for x in pdf["counts"])
            return pd.DataFrame({"piece": [piece], "counts": [planes(np.minimum(add, 2**32 - 1))]})
        sizes: dict[int, int] = {}
        for x in pdf["counts"]:
            for n, c in np.frombuffer(zlib.decompress(x), np.int64).reshape(-1, 2).tolist():
                sizes[n] = sizes.get(n, 0) + c
        return pd.DataFrame({"piece": [-1], "counts": [zlib.compress(np.array(sorted(sizes.items()), np.int64).tobytes())]})

    names = ["piece", "counts", "id", "n", "a", "b"]
    both = durable(in_arrow(docs, local, "piece int, counts binary, id long, n long, a long, b long"))
    slots, sizes = np.zeros(SLOTS, np.uint32), {}
    for piece, x in both.where("piece is not null").select("piece", "counts").groupBy("piece").applyInPandas(total, "piece int, counts binary").collect():
        if piece >= 0:
            slots[piece * CHUNK : (piece + 1) * CHUNK] = from_planes(x)
        else:
            sizes = {n: c for n, c in np.frombuffer(zlib.decompress(x), np.int64).reshape(-1, 2).tolist()}
    return both.where("piece is null").select("id", "n", "a", "b"), sizes, slots


def described(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and fingerprint of each set."""
    with np.errstate(over="ignore"):
        prints = [(int(s.sum(dtype=np.uint64)), int(mixed(s ^ np.uint64(BASE)).sum(dtype=np.uint64))) for s in sets]
    both = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
    return [pa.array([len(s) for s in sets], pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]


def levels_of(slots: np.ndarray) -> tuple[np.ndarray, float]:
    """Level of each slot, and what a slot usually holds. A level counts doublings of the excess over that, in units of the usual
    spread, so that a passage of a few dozen documents shows at any load of the sketch that it exceeds by twice the spread."""
    occupied = slots[slots > 0]
    if not len(occupied):
        return np.zeros(len(slots), np.uint8), 1.0
    usual, upper = np.quantile(occupied, [0.5, 0.84])
    spread = max(upper - usual, float(np.sqrt(usual)))
    return np.floor(np.log2(np.maximum((slots - usual) / spread, 1))).astype(np.uint8), float(usual)


def choose_boundary(sizes: dict[int, int], per_cent: int, scan: float) -> int:
    """The size of least cost up to which sets enumerate 2-subsets: a key costs 1, an inverted list one key and ``scan`` reads."""
    ns = np.array(sorted(n for n in sizes if n > 0), np.int64)
    if not len(ns):
        return 0
    count = np.array([sizes[n] for n in ns.tolist()], np.float64)
    one = ns - least_shared(ns, per_cent) + 1
    two = np.minimum(one + 1, ns)
    light, heavy = count * two * (two - 1) / 2, count * one * (1 + scan)
    costs = [(heavy.sum(), 0)]
    for x in ns[ns <= 64].tolist():
        costs.append((light[ns <= x].sum() + heavy[ns * 100 >= per_cent * (x + 1)].sum(), x))
    return min(costs)[1]


def prefixed(docs: DataFrame, k: int, per_cent: int, level: np.ndarray) -> DataFrame:
    """rep (least id), n, fingerprint (a, b) and ordered prefix of every class of equal sets, written out. Rows of no id make none."""
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(level.tobytes(), 1))

    def run(batches):
        shingler, levels = Shingler(k), np.frombuffer(zlib.decompress(shared.value), np.uint8)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                sets = shingler.sets(raw_texts(part.column(1)))
                prefixes = [np.sort((levels[s & np.uint64(SLOTS - 1)].astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6)))[: len(s) - least_shared(len(s), per_cent) + 2] for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *described(sets), lists([x.view(np.int64) for x in prefixes])], ["id", "n", "a", "b", "prefix"])

    rows = in_arrow(docs, run, "id long, n long, a long, b long, prefix array<long>").where("n > 0 and id is not null")
    return durable(rows.groupBy("n", "a", "b").agg(F.min("id").alias("rep"), F.first("prefix").alias("prefix")))


def posted(classes: DataFrame, per_cent: int, boundary: int) -> DataFrame:
    """rep, n, join key and its place for every join key: the 2-subsets of the prefix for light sets, single members for heavy
    sets and the light ones within their reach. Of a pair's first shared key at places p, q at most 1 + min(n - p, m - q) members
    are shared; of a 2-subset the place of its second member less one tells the same."""
    two = f"""if(n <= {boundary} and size(prefix) > 1, flatten(transform(sequence(0, size(prefix) - 2),
        i -> transform(sequence(i + 1, size(prefix) - 1), j -> named_struct('key', xxhash64(prefix[i], prefix[j]), 'place', j)))), array())"""
    one = f"""if(n * 100 >= {per_cent * (boundary + 1)}, transform(slice(prefix, 1, cast(n - ceil_div(n) + 1 as int)), (x, i) -> named_struct('key', x, 'place', i + 1)), array())"""
    one = one.replace("ceil_div(n)", f"(n * {per_cent} + 99) div 100")
    return classes.select("rep", "n", F.explode(F.concat(F.expr(two), F.expr(one))).alias("k")).select("rep", "n", "k.key", "k.place")


def may_match(n: str, p: str, m: str, q: str, per_cent: int) -> Column:
    """Whether sets of sizes n and m whose first shared key is at places p and q can be similar. Exact: only dissimilar pairs go, and
    a similar pair holds at its first shared key, whatever it is at others."""
    n, p, m, q = (F.col(x) for x in (n, p, m, q))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * per_cent) & ((1 + F.least(n - p, m - q)) * (100 + per_cent) >= (n + m) * per_cent)


def possible(pairs: DataFrame, classes: DataFrame, per_cent: int) -> DataFrame:
    """Those (x, y) of ``pairs`` that their prefixes leave possible: up to the lesser of the prefixes' ends both sets are known, so
    what they do not share there counts against the difference that the sizes allow. Exact: only dissimilar pairs go."""
    one, two = (classes.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("prefix").alias(f"p{c}")) for c in "xy")
    both = pairs.join(one, "x").join(two, "y")
    end = F.least(F.element_at("px", -1), F.element_at("py", -1))
    known = F.size(F.filter("px", lambda v: v <= end)) + F.size(F.filter("py", lambda v: v <= end))
    sizes = F.col("nx") + F.col("ny")
    allowed = sizes - 2 * F.ceil(sizes * per_cent / (100 + per_cent) - 1e-9)
    return both.where(known - 2 * F.size(F.array_intersect("px", "py")) <= allowed).select("x", "y")


def sets_of(docs: DataFrame, ids: DataFrame, k: int, short: bool = False) -> DataFrame:
    """id and ``s``, the shingle hashes of the texts of ``ids``; short: their distinct low halves."""
    kind = np.uint32 if short else np.uint64
    ids = durable(ids)

    def run(batches):
        shingler = Shingler(k)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                sets = [(np.unique(s.astype(kind)) if short else s).view(np.int32 if short else np.int64) for s in shingler.sets(raw_texts(part.column(1)))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), lists(sets)], ["id", "s"])

    return in_arrow(docs.join(broadcast_if(ids, ids.count(), 2_000_000), "id", "left_semi"), run, f"id long, s array<{'int' if short else 'long'}>")


def verified(pairs: DataFrame, docs: DataFrame, k: int, per_cent: int) -> DataFrame:
    """Those (x, y) of ``pairs`` whose sets are similar enough. Only texts that a pair names are read again and moved."""
    pairs = durable(pairs)
    sets = sets_of(docs, pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct(), k)
    both = pairs.join(sets.select(F.col("id").alias("x"), F.col("s").alias("sx")), "x").join(sets.select(F.col("id").alias("y"), F.col("s").alias("sy")), "y")
    shared = F.size(F.array_intersect("sx", "sy"))
    return both.where(100 * shared >= per_cent * (F.size("sx") + F.size("sy") - shared)).select("x", "y").distinct()


def home_groups(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the members of crowded keys are compared. left: key, rep, n, component and the key's members.

    A member's home is its key of most members. First result: for each key that is a home, all its members, and whether it is their
    own home. Second: each member's home.
    """
    crowded = left.where(F.col("members") >= CROWD)
    home = crowded.groupBy("rep").agg(F.max(F.struct("members", "key")).alias("h")).select("rep", F.col("h.key").alias("home"))
    home = durable(home)
    guests = crowded.join(home.select(F.col("home").alias("key")).distinct(), "key").join(home, "rep")
    return guests.select("key", "rep", "n", "component", (F.col("home") == F.col("key")).alias("own")), home


def shared_counts(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Members that each set of ``one`` shares with each other one of ``two`` (places in ``sets``, whose members are distinct 32-bit
    integers). Holds some 20 bytes for a member."""
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable").astype(np.int32)
    flat = flat[order]
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[order]
    del order
    new = np.ones(len(flat) + 1, bool)
    np.not_equal(flat[1:], flat[:-1], out=new[1:-1])
    del flat
    many = ~(new[:-1] & new[1:])  # those of one set alone are shared with none
    row, column = row[many], np.cumsum(new[:-1][many], dtype=np.int32) - np.int32(1)
    shared = np.zeros((len(one), len(two)), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 1024):
        lo, hi = np.searchsorted(column, np.array([a, a + 1024], np.int32))
        x = np.zeros((len(sets), 1024), np.float32)
        x[row[lo:hi], column[lo:hi] - a] = 1
        shared += x[one] @ x[two].T
    return shared


def compare(pdf: pd.DataFrame, per_cent: int) -> pd.DataFrame:
    """Pairs of two blocks whose sets may be similar enough: one of them at its own home, and in different components."""
    pdf = pdf.drop_duplicates("id")
    one, two = (np.flatnonzero((pdf["b"] == pdf[c].iloc[0]).to_numpy()) for c in "ij")
    lost = (pdf["n"] - pdf["s"].map(len)).to_numpy()
    shared = shared_counts(pdf.pop("s").tolist(), one, two)
    n, own, group, ids = (pdf[c].to_numpy() for c in ("n", "own", "component", "id"))
    shared += np.minimum(lost[one][:, None], lost[two][None, :])
    union = n[one][:, None] + n[two][None, :] - shared
    found = (100 * shared >= per_cent * union) & (own[one][:, None] | own[two][None, :]) & (group[one][:, None] != group[two][None, :])
    x, y = np.nonzero(found)
    return pd.DataFrame({"x": ids[one[x]], "y": ids[two[y]]})


def compared_in_blocks(guests: DataFrame, docs: DataFrame, k: int, per_cent: int) -> DataFrame:
    """Links (x, y) between members of a key in different components, one of whom is its own.

    A key's members are dealt to blocks of about ``BLOCK``, or of ``BLOCK_MEMBERS`` members of their sets; a task holds two blocks and counts shared members of all their sets as a product of
    0/1 matrices, so near misses of a crowded group are compared without a row for each pair. The sets move as half hashes; what hashes
    a set loses by that counts as shared, so no link is lost, and the few pairs found are verified with whole hashes.
    """
    guests = durable(guests)
    if not guests.isEmpty():
        give_back(guests.sparkSession)
    sizes = guests.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("all")).where("members > 1")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("all") / BLOCK_MEMBERS))
    dealt = guests.join(sizes, "key").withColumn("b", F.pmod(F.xxhash64("rep"), blocks)).withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    dealt = dealt.select("key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", F.col("rep").alias("id"), "n", "component", "own")

    sets = sets_of(docs, guests.select(F.col("rep").alias("id")).distinct(), k, short=True)
    found = dealt.join(sets, "id").groupBy("key", "i", "j").applyInPandas(lambda pdf: compare(pdf, per_cent), "x long, y long")
    return verified(found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), docs, k, per_cent)


def ngram_components(docs: DataFrame, k: int = 4, per_cent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every row. Ids must be integers."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows, counts, slots = survey(docs, k)
    level, usual = levels_of(slots)
    classes = prefixed(docs, k, per_cent, level)
    postings = posted(classes, per_cent, choose_boundary(counts, per_cent, max(1.0, usual)))
    leads = (1 + F.col("n") - F.col("place")) * (100 + per_cent) >= 2 * per_cent * F.col("n")  # the smaller of a similar pair does at their first shared key
    keys = postings.groupBy("key").agg(F.count("*").alias("members"), F.max(leads).alias("led"), F.min(F.struct("rep", "n", "place")).alias("c1"), F.min(F.struct(F.xxhash64("rep").alias("h"), "rep", "n", "place")).alias("c2"))
    keys = keys.where("members > 1 and led").select("key", "c1", F.struct("c2.rep", "c2.n", "c2.place").alias("c2"))
    live = durable(postings.join(keys, "key"))

    first = live.select("rep", "n", "place", F.explode(F.array("c1", "c2")).alias("c")).select("rep", "n", "place", F.col("c.rep").alias("c"), F.col("c.n").alias("m"), F.col("c.place").alias("q"))
    first = first.where((F.col("rep") != F.col("c")) & may_match("n", "place", "m", "q", per_cent))
    tried = durable(first.select(F.least("rep", "c").alias("x"), F.greatest("rep", "c").alias("y")).distinct())
    links = durable(verified(possible(tried, classes, per_cent), docs, k, per_cent))
    joined = durable(components(links))

    labelled = live.select("key", "rep", "n", "place").join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left").select("key", "rep", "n", "place", F.coalesce("component", "rep").alias("component"))
    labelled = durable(labelled)
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo != hi").select("key", "members")
    left = durable(labelled.join(open_keys, "key"))
    guests, homes = home_groups(left)
    at_home = durable(compared_in_blocks(guests, docs, k, per_cent))

    # Who is at home at a key has met all there, and so have those of one home. The others meet at the key.
    away = left.join(homes, "rep", "left").where(F.col("home").isNull() | (F.col("home") != F.col("key"))).drop("members")
    open_keys = away.groupBy("key").agg(F.count("*").alias("members"), F.min("home").alias("lo"), F.max("home").alias("hi"), F.count("home").alias("homed"))
    open_keys = open_keys.where((F.col("members") > 1) & ~((F.col("homed") == F.col("members")) & (F.col("lo") == F.col("hi")))).select("key", "members")
    away = durable(away.join(durable(open_keys), "key"))  # written first, so that a frequent key's rows can be split in the join
    met_away = durable(compared_in_blocks(away.where(F.col("members") >= CROWD).select("key", "rep", "n", "component", F.lit(True).alias("own")), docs, k, per_cent))
    names = ("rep", "n", "place", "component")
    p, q = (away.where(F.col("members") < CROWD).select("key", *(F.col(c).alias(f"{side}_{c}") for c in names)) for side in "pq")
    close = may_match("p_n", "p_place", "q_n", "q_place", per_cent) & (F.col("p_component") != F.col("q_component")) & (F.col("p_rep") < F.col("q_rep"))
    rest = p.join(q, "key").where(close).select(F.col("p_rep").alias("x"), F.col("q_rep").alias("y")).distinct().join(tried, ["x", "y"], "left_anti")
    more = verified(possible(rest, classes, per_cent), docs, k, per_cent)
    final = durable(components(links.union(at_home).union(met_away).union(more)))

    of_class = classes.join(final.select(F.col("id").alias("rep"), "component"), "rep", "left").select("n", "a", "b", F.coalesce("component", "rep").alias("component"))
    out = rows.select("id", F.col("n").alias("n_shingles"), "n", "a", "b").join(of_class, ["n", "a", "b"], "left")
    alone = F.col("n_shingles") == 0
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(alone | F.col("id").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all columns: that of least id (null ids last). Rows without a word are in no group
    and stay. Rows that share an id, and rows without one, are told apart by a number of their own, so one of each group stays of them too.
    """
    ids = docs.groupBy(id_col).agg(F.count("*").alias("rows"))
    if ids.where(F.col(id_col).isNull() | (F.col("rows") > 1)).isEmpty():
        gone = durable(ngram_components(docs, k, per_cent, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(id_col).distinct())
        return docs.join(broadcast_if(gone, gone.count(), 2_000_000), id_col, "left_anti").select(*docs.columns)
    row = next(f"row{i}" for i in range(len(docs.columns) + 1) if f"row{i}" not in docs.columns)
    numbered = durable(docs.withColumn(row, F.monotonically_increasing_id()))
    classes = ngram_components(numbered, k, per_cent, row, text_col).where("n_shingles > 0").select(row, "component_id")
    order = F.struct(F.col(id_col).isNull(), id_col, row)
    best = durable(classes.join(numbered.select(id_col, row), row).groupBy("component_id").agg(F.min(order).alias("least")).select(F.col(f"least.{row}").alias(row)))
    gone = durable(classes.select(row).join(best, row, "left_anti"))
    return numbered.join(broadcast_if(gone, gone.count(), 2_000_000), row, "left_anti").select(*docs.columns)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read_table(spark, sf_dir, "documents"))
