"""Best-fit packing by hierarchical residual packing.

Each partition tokenizes its documents, cuts only those over ``capacity`` into pieces, and packs its pieces
best-fit, longest first. Bins whose residual is at most ``slack`` are final. Underfull bins go on as items:
rounds merge partitions ``fan_in`` to one and pack best-fit again, until one partition holds the rest. No task
holds over about ``most_items`` bins: where more are left, rounds go on over as many partitions as they need, dealt anew
each time, until a round saves less than a thousandth of its bins. A round moves bin numbers and sizes only; places within a bin are
composed by joins on the bin number.

Defined results: null and empty texts are the single id 0; null ids stay null; repeated rows are packed each;
an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.llm.common import durable, in_arrow, read_table
from simloom.llm.tokens import ChunkEncoder, tokenizer_path


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each item, its place in the bin, and the bins' sizes: longest items first, each into the fullest bin that has room."""
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    filled: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin has room for r more
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(filled)
            filled.append(0)
        bins[i], places[i] = b, filled[b]
        filled[b] += s
        left = room - s
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, places, np.array(filled, np.int64)


def pieces(docs: DataFrame, path: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Every piece, packed best-fit within its partition: bin, its size, and the place in it."""
    schema = docs.select(id_col).schema
    for name, kind in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("bin", T.LongType()), ("place", T.LongType()), ("bin_size", T.LongType()), ("first", T.BooleanType())):
        schema = schema.add(name, kind)

    def run(batches):
        tool, ids, rows = ChunkEncoder(path), [], []
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                for key, raw in zip(part.column(0), tool.encode(part.column(1).to_pylist())):
                    raw += b"\0\0\0\0"
                    for k, start in enumerate(range(0, len(raw), 4 * capacity)):
                        cut = raw[start : start + 4 * capacity]
                        ids.append(key)
                        rows.append((k, start // 4, len(cut) // 4, zlib.crc32(cut)))
        if rows:
            x = np.array(rows, np.int64)
            bins, places, sizes = best_fit(x[:, 2], capacity)
            number = (TaskContext.get().partitionId() << 32) + bins
            columns = [pa.array([k.as_py() for k in ids], ids[0].type), pa.array(x[:, 0].astype(np.int32)), *(pa.array(x[:, j]) for j in (1, 2, 3)), pa.array(number), pa.array(places), pa.array(sizes[bins]), pa.array(places == 0)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return in_arrow(docs.select(id_col, text_col), run, schema)


def merge_round(items: DataFrame, level: int, parts: int, capacity: int) -> DataFrame:
    """items: bin and bin_size, underfull. Packs them as items: bin, its parent and place there, and the parent's size."""

    def run(batches):
        got = pd.concat([*batches, pd.DataFrame({"bin": [], "bin_size": []}, dtype="int64")])
        bins, places, sizes = best_fit(got["bin_size"].to_numpy(np.int64), capacity)
        number = (level << 56) + (TaskContext.get().partitionId() << 32) + bins
        yield pd.DataFrame({"bin": got["bin"].to_numpy(), "parent": number, "shift": places, "parent_size": sizes[bins] if len(bins) else bins})

    return items.repartition(parts, F.xxhash64("bin", F.lit(level))).mapInPandas(run, "bin long, parent long, shift long, parent_size long")


def pack(docs: DataFrame, path: str, capacity: int = 2048, slack: int = 4, fan_in: int = 8, most_items: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    out = durable(pieces(docs, path, capacity, id_col, text_col)).withColumnsRenamed({"bin": "sequence_id", "place": "offset"})
    open_bins = out.where(F.col("first") & (F.col("bin_size") < capacity - slack)).select(F.col("sequence_id").alias("bin"), "bin_size")
    parts, level, before = docs.rdd.getNumPartitions(), 0, None
    while True:
        count = open_bins.count()
        fewest = max(-(-count // most_items), 1)
        if count == 0 or level and parts == 1 or parts <= fewest and before is not None and count > 0.999 * before:
            break
        before = count if parts <= fewest else None
        parts, level = max(-(-parts // fan_in), fewest), level + 1
        moved = durable(merge_round(open_bins, level, parts, capacity))
        out = out.join(moved.withColumnRenamed("bin", "sequence_id"), "sequence_id", "left")
        out = out.withColumns({"offset": F.col("offset") + F.coalesce("shift", F.lit(0)), "sequence_id": F.coalesce("parent", "sequence_id")}).drop("parent", "shift", "parent_size")
        open_bins = moved.where((F.col("parent_size") < capacity - slack) & (F.col("shift") == 0)).select(F.col("parent").alias("bin"), F.col("parent_size").alias("bin_size"))
    return out.select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path())
