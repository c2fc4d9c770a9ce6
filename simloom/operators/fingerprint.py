"""From samples to fingerprints: shredding, winnowing, feature hashing, filters and catalogue.

A sample is a row with an id and its bytes or text (or an array of code sections). Shreds never cross sections.
A fingerprint is the sorted array of distinct bit positions; ``postings`` is its exploded form.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.common import in_arrow, in_parts, integer_lists, pieces, settled
from simloom.functions.hashing import rolling, span_hashes
from simloom.params import Params

LINE_BYTES = 8190  #: Fixed value: a longer line is read in pieces of so many bytes.
SHRED_BYTES = 1 << 18  #: Samples are shredded together up to so many bytes: their hashes and places take some 40 times as many.


def text_spans(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line with its newline, in pieces of ``LINE_BYTES``, each up to its first NUL byte; and of each text between
    ``edges`` its first piece."""
    line = np.unique(np.concatenate([edges, np.flatnonzero(data == 10) + 1]))
    begin, size = line[:-1], np.diff(line)
    parts = -(-size // LINE_BYTES)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(begin, parts) + number * LINE_BYTES
    ends = np.minimum(starts + LINE_BYTES, np.repeat(begin + size, parts))
    nul = np.flatnonzero(data == 0)
    if len(nul):
        next_nul = np.append(nul, len(data))[np.searchsorted(nul, starts)]
        ends = np.minimum(ends, next_nul)
    return starts, ends, np.searchsorted(starts, edges)


def text_shreds(texts: list[bytes], size: int, kind: str = "djb2") -> list[np.ndarray]:
    """Of each text the hash of each run of ``size`` lines."""
    if not texts:
        return []
    data = np.frombuffer(b"".join(texts), np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts, ends, place = text_spans(data, edges)
    counts = np.maximum(np.diff(place) - size + 1, 0)
    cuts = np.cumsum(counts)
    first = np.arange(int(counts.sum())) + np.repeat(place[:-1] - (cuts - counts), counts)
    return np.split(span_hashes(data, starts, ends, size, first, kind), cuts[:-1])


def byte_shreds(sections: list[bytes], size: int, kind: str = "djb2") -> np.ndarray:
    parts = [rolling(np.frombuffer(s, np.uint8), size, kind) for s in sections]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of every window, the rightmost of equals."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    if window == 1:
        return np.arange(len(hashes))
    # Least of numbers that hold the hash and, below it, how far from the end it stands; of windows of 1, 2, 4 and so on, and two of these for the rest.
    least, width = hashes.astype(np.uint64) << np.uint64(32) | np.arange(len(hashes) - 1, -1, -1, dtype=np.uint64), 1
    while width < window:
        step = min(width, window - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    at = len(hashes) - 1 - (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def shreds(samples: DataFrame, params: Params, mode: str = "text", id_col: str = "vid", data_col: str = "data", kind: str | tuple[str, ...] = "djb2", keep: str = "all") -> DataFrame:
    """id and ``hashes`` array<bigint>, ``at`` array<int>: all shreds of a sample, or those that winnowing selects. Of several hash functions
    the hashes of one follow those of the other."""
    kinds = (kind,) if isinstance(kind, str) else kind
    schema = samples.select(id_col).schema.add("nshred", "long").add("hashes", T.ArrayType(T.LongType())).add("at", T.ArrayType(T.IntegerType()))

    def run(batches):
        for b in pieces(batches, 1, SHRED_BYTES):
            cells = b.column(1).to_pylist()
            if mode == "text":
                texts = [as_bytes(x) for x in cells]
                each = [text_shreds(texts, params.shred_size, k) for k in kinds]
            else:
                sections = [[as_bytes(s) for s in x] if isinstance(x, list) else [as_bytes(x)] for x in cells]
                each = [[byte_shreds(x, params.shred_size, k) for x in sections] for k in kinds]
            found = [np.concatenate(x) for x in zip(*each)] if len(kinds) > 1 else each[0]
            places = [winnow(h, params.window_size) if keep == "winnowed" else np.arange(len(h)) for h in found]
            hashes = integer_lists([h[at].astype(np.int64) for h, at in zip(found, places)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) // len(kinds) for h in found], pa.int64()), hashes, integer_lists([at.astype(np.int32) for at in places])], [id_col, "nshred", "hashes", "at"])

    return in_arrow(spread(samples.select(id_col, data_col)), run, schema)


def spread(df: DataFrame) -> DataFrame:
    """A small table is one file, and so one task: it is dealt to as many tasks as run at once."""
    n = df.sparkSession.sparkContext.defaultParallelism
    few = not df.isStreaming and 0 < len(df.inputFiles()) < n  # only then is it cheap to ask for partitions
    return df.repartition(n) if few and df.rdd.getNumPartitions() < n else df


def as_bytes(x: str | bytes | None) -> bytes:
    return x.encode() if isinstance(x, str) else x or b""


def exploded(shredded: DataFrame, id_col: str = "vid") -> DataFrame:
    """id, pos and hash, one row a shred."""
    pair = F.explode(F.arrays_zip("at", "hashes")).alias("x")
    return shredded.select(id_col, pair).select(id_col, F.col("x.at").alias("pos"), F.col("x.hashes").alias("hash"))


def winnowed_rows(rows: DataFrame, window: int, id_col: str = "vid") -> DataFrame:
    """Winnowing of exploded shreds as a window frame: id, pos and hash of the selected ones. The array form does the same without a sort."""
    frame = Window.partitionBy(id_col).orderBy("pos").rowsBetween(0, window - 1)
    least = rows.select(id_col, F.min(F.struct("hash", (-F.col("pos")).alias("back"))).over(frame).alias("m"), F.count("*").over(frame).alias("n"))
    return least.where(F.col("n") == window).select(id_col, (-F.col("m.back")).alias("pos"), F.col("m.hash").alias("hash")).distinct()


def fingerprints(samples: DataFrame, params: Params, mode: str = "text", id_col: str = "vid", data_col: str = "data") -> DataFrame:
    """id, nshred, nhash, nbits and bits of the samples that have a window of shreds at least."""
    mask = params.fp_bits - 1

    def bits(column: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(column, lambda h: h.bitwiseAND(F.lit(mask).cast("bigint")).cast("int"))))

    if len(params.hashes) > 1 and params.window_size > 1:
        raise ValueError("several hash functions need a window of 1")
    base = shreds(samples, params, mode, id_col, data_col, params.hashes, "winnowed").where(F.col("nshred") >= params.window_size)
    out = base.select(id_col, "nshred", (F.size("hashes") / len(params.hashes)).cast("long").alias("nhash"), bits(F.col("hashes")).alias("bits"))
    return out.withColumn("nbits", F.size("bits").cast("long")).where("nhash > 0").select(id_col, "nshred", "nhash", "nbits", "bits")


def catalogue(samples: DataFrame, fps: DataFrame, params: Params, id_col: str = "vid") -> DataFrame:
    """Every sample with its status: accepted, too_small or too_dense (over max_set_ratio of the bits)."""
    most = params.fp_bits * params.max_set_ratio if params.max_set_ratio is not None else float("inf")
    found = samples.select(id_col).join(fps.select(id_col, "nshred", "nhash", "nbits"), id_col, "left")
    return found.withColumn("status", F.when(F.col("nbits").isNull(), "too_small").when(F.col("nbits") > most, "too_dense").otherwise("accepted"))


def accepted(fps: DataFrame, params: Params) -> DataFrame:
    return fps if params.max_set_ratio is None else fps.where(F.col("nbits") <= params.fp_bits * params.max_set_ratio)


def with_vids(rows: DataFrame, key: str | list[str], base: int = 0, name: str = "vid", parts: int | None = None) -> DataFrame:
    """Dense ids in the order of ``key``: sorted partitions (``parts``, where the session's number is too low for the rows), each offset by
    the rows before it; only one count a partition goes to the driver. A row's place in its partition is noted as it is written."""
    keys = [key] if isinstance(key, str) else key
    ranged = rows.repartitionByRange(*([parts] if parts else []), *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    ranged = settled(ranged.withColumn("part", F.shiftright("at", 33).cast("int")).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))))
    counts = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect())
    offsets, total = [], base
    for part, n in counts:
        offsets.append((part, total))
        total += n
    table = rows.sparkSession.createDataFrame(offsets or [(0, base)], "part int, before long")
    return ranged.join(F.broadcast(table), "part").select((F.col("before") + F.col("at")).alias(name), *rows.columns)


def postings(fps: DataFrame, id_col: str = "vid") -> DataFrame:
    return fps.select(id_col, "nbits", F.explode("bits").alias("bit"))


def vinfo(fps: DataFrame, vid: int, params: Params, id_col: str = "vid") -> DataFrame:
    """Set and clear bits of one sample; empty if there is none."""
    return fps.where(F.col(id_col) == vid).select(id_col, F.col("nbits").alias("n_set"), (F.lit(params.fp_bits).cast("long") - F.col("nbits")).alias("n_clear"))


def zero_columns(fps: DataFrame, params: Params) -> DataFrame:
    """How many of the bit positions no sample sets."""
    return fps.select(F.explode("bits").alias("bit")).agg((F.lit(params.fp_bits).cast("long") - F.count_distinct("bit")).alias("zero_columns"))


def dense(fps: DataFrame, params: Params, id_col: str = "vid") -> DataFrame:
    """id and ``fp`` BINARY of fp_bits / 8 bytes, least significant bit first."""

    def packed(bits: list[int] | None) -> bytes:
        v = np.zeros(params.fp_bits, np.uint8)
        v[bits or []] = 1
        return np.packbits(v, bitorder="little").tobytes()

    def run(batches):
        for b in batches:
            for rows in in_parts(list(range(b.num_rows)), params.fp_bits // 8):
                part = b.slice(rows[0], len(rows))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([packed(x) for x in part.column(1).to_pylist()], pa.binary())], [id_col, "fp"])

    return in_arrow(fps.select(id_col, "bits"), run, fps.select(id_col).schema.add("fp", "binary"))


def from_dense(rows: DataFrame, params: Params, id_col: str = "path", data_col: str = "content") -> DataFrame:
    """Fingerprints of files that hold one dense matrix each: file, row in file, nbits and bits."""
    size = params.fp_bits // 8
    schema = rows.select(id_col).schema.add("row", "long").add("nbits", "long").add("bits", T.ArrayType(T.IntegerType()))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(1)[i].as_buffer() if b.column(1)[i].is_valid else b""
                for numbers in in_parts(list(range(len(data) // size)), 4 * params.fp_bits):
                    found = [np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, j * size), bitorder="little")).astype(np.int32) for j in numbers]
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(found), b.column(0).type), pa.array(numbers, pa.int64()), pa.array([len(r) for r in found], pa.int64()), integer_lists(found)], [id_col, "row", "nbits", "bits"])

    return in_arrow(rows.select(id_col, data_col), run, schema)


def ascii_matrix(fps: DataFrame, params: Params, id_col: str = "vid") -> DataFrame:
    """One string of 0 and 1 for each sample; for small fp_bits."""
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(params.fp_bits - 1)), lambda i: F.when(F.array_contains("bits", i), "1").otherwise("0")), "")
    return fps.select(id_col, line.alias("line"))


def run_statistics(samples: DataFrame, fps: DataFrame, data_col: str = "data") -> DataFrame:
    """Samples, bytes, accepted samples, shreds and set bits in one row."""
    size = samples.agg(F.count("*").alias("samples"), F.coalesce(F.sum(F.octet_length(data_col)), F.lit(0)).cast("long").alias("bytes"))
    got = fps.agg(F.count("*").alias("fingerprinted"), F.coalesce(F.sum("nshred"), F.lit(0)).alias("nshred"), F.coalesce(F.sum("nbits"), F.lit(0)).alias("nbits"))
    return size.join(F.broadcast(got))
