"""Incremental comparison of arriving samples: each batch is appended to the store and compared with all before it once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.operators.fingerprint import accepted, fingerprints
from simloom.operators.similarity import incremental_join
from simloom.params import Params


def batch_writer(store: str, pairs: str, params: Params, mode: str = "text", id_col: str = "vid", data_col: str = "data"):
    """A function for foreachBatch. Ids must grow from batch to batch, or the batch fails. A repeated batch replaces its own folders, so results stay whole."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = accepted(fingerprints(batch, params, mode, id_col, data_col), params)
        own.write.mode("overwrite").parquet(f"{store}/batch_id={number}")
        stored = spark.read.parquet(store).where(F.col("batch_id") <= number)
        before = stored.where(F.col("batch_id") < number).agg(F.coalesce(F.max(id_col), F.lit(-1))).first()[0]
        least = stored.where(F.col("batch_id") == number).agg(F.min(id_col)).first()[0]
        if least is not None and least <= before:
            raise ValueError(f"batch {number} has the id {least}, not over {before} of the batches before")
        stored = stored.drop("batch_id")
        incremental_join(stored, before, params.threshold, id_col=id_col).write.mode("overwrite").parquet(f"{pairs}/batch_id={number}")

    return write


def start(samples: DataFrame, store: str, pairs: str, checkpoint: str, params: Params, **how: str):
    """samples: a streaming frame. Returns the running query."""
    return samples.writeStream.foreachBatch(batch_writer(store, pairs, params, **how)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
