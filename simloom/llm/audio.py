"""Chroma audio fingerprints for media columns, and alignment of recordings by them.

Samples become magnitude spectra of overlapping windows, spectra become 12 pitch-class energies a frame, and 16 filters over an
integral image of the frames compare the energies of two areas each. A filter's log ratio is quantised to two Gray-coded bits, so each
frame gives one 32-bit integer. Recordings are matched by pairs of equal integers, ``LAGS`` frames apart: a histogram of the offsets between
equal pairs gives the best alignment, and the share of different bits over the overlap says how good it is. (Single integers of short
notes meet by chance, and so often that their join grows with the square of the recordings; pairs hardly do. README has the recall.)

Recordings with equal fingerprints are one class, so copies are compared once. Of a run of one and the same pair, as a steady tone makes,
only the first counts, and pairs of frames without any energy do not: silence matches nothing. Queries meet the inverted list of pairs by
an equi-join; nothing is capped.

Defined results: null, too short and silent recordings match nothing (the first two have an empty fingerprint); a null id is skipped as a
query; repeated rows join their class; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.llm.common import broadcast_if, durable, in_arrow, read_table

RATE, FRAME, HOP, SPAN = 4000, 1024, 256, 16
LAGS = (1, 2, 3)
#: Of each of the 16 filters by rule: kind, lowest pitch class, classes, frames.
FILTERS = [(i % 6, y := (5 * i) % 12, 1 + (7 * i + 3) % (12 - y), 4 + (3 * i) % (SPAN - 3)) for i in range(16)]
LEVELS = np.array([-0.4, 0.0, 0.4])


def pitch_classes(frame: int = FRAME, rate: int = RATE) -> np.ndarray:
    """Matrix from spectrum bins to pitch classes, between 50 and 1800 Hz."""
    hz = np.arange(frame // 2 + 1) * rate / frame
    fold = np.zeros((len(hz), 12), np.float32)
    for i, f in enumerate(hz):
        if 50 <= f <= 1800:
            fold[i, int(round(12 * np.log2(f / 440.0))) % 12] = 1
    return fold


FOLD, TAPER = pitch_classes(), np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """[frames, 12] energies of a mono recording."""
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12))
    view = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[:: HOP][:n]
    energy = np.concatenate([np.abs(np.fft.rfft(view[a : a + 2048] * TAPER, axis=1)) ** 2 @ FOLD for a in range(0, n, 2048)])
    total = energy.sum(1, keepdims=True)
    return np.where(total > 1e-6, energy / np.maximum(total, 1e-6), 0)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer for each window of ``SPAN`` frames."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return image[t1 : t1 + n, y1] - image[t0 : t0 + n, y1] - image[t1 : t1 + n, y0] + image[t0 : t0 + n, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        t2, h2, third = w // 2, max(h // 2, 1), max(w // 3, 1)
        whole = area(0, w, y, y + h)
        if kind == 0:
            one = area(0, w, 0, 12) - whole
            two = whole
        elif kind == 1:
            one, two = area(0, t2, y, y + h), area(t2, w, y, y + h)
        elif kind == 2:
            one = area(0, w, y, y + h2)
            two = whole - one
        elif kind == 3:
            one = area(0, t2, y, y + h2) + area(t2, w, y + h2, y + h)
            two = whole - one
        elif kind == 4:
            two = area(third, w - third, y, y + h)
            one = whole - two
        else:
            two = area(0, w, max(y - 1, 0), y + h)
            one = area(0, SPAN, 0, 12) - two
        level = np.searchsorted(LEVELS, np.log((1e-3 + np.maximum(one, 0)) / (1e-3 + np.maximum(two, 0))))
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    return out


def melody(vector: list[float] | None, note_s: float = 0.125, notes: int | None = None) -> np.ndarray:
    """A recording that a vector determines: one note of two partials for each entry (of the first ``notes``). Test tables hold no audio."""
    values = np.abs(np.array([x or 0.0 for x in (vector or [])[:notes]], np.float64))
    if not len(values):
        return np.zeros(0, np.float32)
    hz = 110.0 * 2 ** ((np.floor(values * 1000) % 24) / 12)
    per = int(RATE * note_s)
    phase = 2 * np.pi * np.cumsum(np.repeat(hz, per)) / RATE
    return (0.7 * np.sin(phase) + 0.3 * np.sin(2 * phase)).astype(np.float32)


def fingerprints(df: DataFrame, id_col: str, media_col: str, decode=None) -> DataFrame:
    """id and ``fp`` array<int> (the bits of unsigned integers). decode: from a cell to samples; None if cells hold samples."""
    schema = df.select(id_col).schema.add("fp", T.ArrayType(T.IntegerType()))

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                cells = part.column(1).to_pylist()
                prints = [fingerprint(chroma(decode(c) if decode else np.array(c or [], np.float32))).view(np.int32) for c in cells]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p.tolist() for p in prints], pa.list_(pa.int32()))], [id_col, "fp"])

    return in_arrow(df.select(id_col, media_col), run, schema)


SILENT = int(fingerprint(np.zeros((SPAN, 12))).view(np.int32)[0])


def pairs_of(prints: DataFrame, id_col: str, place: str) -> DataFrame:
    """id, lag, two integers and their place, of each pair that is not silent and not the pair before it."""
    each = f"""transform(sequence(0, size(fp) - 1 - lag), i -> named_struct('{place}', i, 'lag', lag, 'a', fp[i], 'b', fp[i + lag],
        'new', i = 0 or fp[greatest(i - 1, 0)] != fp[i] or fp[greatest(i - 1, 0) + lag] != fp[i + lag]))"""
    every = F.expr(f"flatten(transform(array({', '.join(map(str, LAGS))}), lag -> if(size(fp) > lag, {each}, array())))")
    return prints.select(id_col, F.explode(F.filter(every, lambda x: x["new"] & ((x["a"] != SILENT) | (x["b"] != SILENT)))).alias("p")).select(id_col, "p.lag", "p.a", "p.b", f"p.{place}")


def align(queries: DataFrame, recordings: DataFrame, min_votes: int = 1, most_error: float = 0.3, id_col: str = "id", broadcast_rows: int = 500_000) -> DataFrame:
    """Both: id and fp. For each query and class of equal recordings, the best offset (of the recording against the query), votes (equal
    pairs at that offset, at least ``min_votes``) and bit error. The pairs of the queries are broadcast if they are few."""
    kinds = durable(recordings.where("size(fp) > 0").groupBy("fp").agg(F.min(id_col).alias("class_id"), F.count("*").alias("class_size")))
    queries = queries.where(F.col(id_col).isNotNull() & (F.size("fp") > 0))
    asked = durable(queries.groupBy("fp").agg(F.min(id_col).alias("q")))
    askers = queries.select(F.col(id_col).alias("query_id"), "fp").distinct().join(asked, "fp").select("query_id", "q")
    left, right = pairs_of(asked, "q", "at"), pairs_of(kinds, "class_id", "place")
    n = asked.agg(F.coalesce(F.sum(F.size("fp")), F.lit(0))).first()[0] * len(LAGS)
    votes = right.join(broadcast_if(left, n, broadcast_rows), ["lag", "a", "b"]).groupBy("q", "class_id", (F.col("place") - F.col("at")).alias("shift")).agg(F.count("*").alias("votes")).where(F.col("votes") >= min_votes)
    best = votes.groupBy("q", "class_id").agg(F.max(F.struct("votes", (-F.col("shift")).alias("s"))).alias("b")).select("q", "class_id", F.col("b.votes").alias("votes"), (-F.col("b.s")).alias("shift"))
    both = best.join(asked.select("q", F.col("fp").alias("fq")), "q").join(kinds.withColumnRenamed("fp", "fc"), "class_id")
    start, end = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("fq"), F.size("fc") - F.col("shift"))
    overlap = (end - start).cast("int")
    bits = F.aggregate(F.zip_with(F.slice("fq", start + 1, overlap), F.slice("fc", start + F.col("shift") + 1, overlap), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    out = both.select("q", "class_id", "class_size", "votes", F.col("shift").alias("offset"), overlap.alias("overlap"), (bits / (32 * overlap)).alias("bit_error")).where(F.col("bit_error") <= most_error)
    return askers.join(out, "q").drop("q")


def members(recordings: DataFrame, id_col: str = "id") -> DataFrame:
    """``recording_id`` and ``class_id`` of every row; the class is null where the fingerprint is empty. A class is never collected into one row."""
    kinds = recordings.where("size(fp) > 0").groupBy("fp").agg(F.min(id_col).alias("class_id"))
    return recordings.select(F.col(id_col).alias("recording_id"), "fp").join(kinds, "fp", "left").select("recording_id", "class_id")


def op6_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording whose id is divisible by 100 against all recordings, as pairs of a query and a class of equal recordings (null
    ``recording_id``), and for every recording a row with its class (null ``query_id``)."""
    prints = durable(fingerprints(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", melody).withColumnRenamed("vec_id", "id"))
    return align(prints.where("id % 100 = 0"), prints).unionByName(members(prints), allowMissingColumns=True)
