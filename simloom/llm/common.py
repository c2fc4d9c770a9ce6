"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom import common
from simloom.common import broadcast_if, scratch
from simloom.common import settled as durable

__all__ = ["broadcast_if", "durable", "fold", "give_back", "in_arrow", "read_table", "scratch", "tidy"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k`` (null ids: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def tidy(run: Callable) -> Callable:
    """For a function of record batches: gives the memory that a task's caches took back to the system when the task ends."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``simloom.common.in_arrow`` of a tidy ``run``: batches are bounded by bytes."""
    return common.in_arrow(df, tidy(run), schema)


def give_back(spark: SparkSession) -> None:
    """Asks the executors for a full collection, after which the JVM returns heap that it does not need: joins leave it at its bound, and
    Python workers that read whole texts next share the machine with it. Results do not depend on it, nor on its reaching all executors."""
    n = 4 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()
