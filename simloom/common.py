"""Written intermediates, counted broadcasts, and Arrow passes of bounded batches."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import simloom

BATCH_BYTES, BATCH_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

# Executors get this package's functions with the task, so they need no copy of it on their path.
cloudpickle.register_pickle_by_value(simloom)

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="simloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def settled(df: DataFrame, keep: bool = False, compression: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage is cut, and no executor's loss undoes it. The table goes when the
    driver ends, or with the ``scratch`` it was made in; with ``keep`` with the one around that."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/simloom/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    system, where = _file_system(spark, path)
    system.deleteOnExit(where)
    if _scopes[: -1 if keep else None]:
        _scopes[-2 if keep else -1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``settled`` writes within go at the end; what is to stay is written within with ``keep``."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            system, where = _file_system(spark, path)
            system.delete(where, True)


def released(spark: SparkSession) -> None:
    """Shuffle files of what is finished go now: else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast hint only where the counted rows are within ``limit``; beyond it the planner shuffles."""
    return F.broadcast(df) if rows <= limit else df


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` over batches of about ``BATCH_BYTES``: batches of a number of rows would grow with the rows. The bound is a setting
    of the session, which is read when the frame runs; it is set here for good, unless the session has one already."""
    conf = df.sparkSession.conf
    if BATCH_KEY not in conf.getAll:
        conf.set(BATCH_KEY, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def pieces(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of rows of about ``size`` bytes of a column; a row of more bytes is one slice."""
    for b in batches:
        a = 0
        while a < b.num_rows:
            z = a + max(1, b.num_rows - a)
            while z - a > 1 and b.column(column).slice(a, z - a).nbytes > size:
                z = a + (z - a) // 2
            yield b.slice(a, z - a)
            a = z


def in_parts(rows: list, row_bytes: int) -> Iterator[list]:
    """``rows`` in lists of about ``BATCH_BYTES``."""
    step = max(1, BATCH_BYTES // max(row_bytes, 1))
    for a in range(0, len(rows), step):
        yield rows[a : a + step]


def integer_lists(arrays: list) -> pa.ListArray:
    """numpy integer arrays of one type as a column of lists."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))
