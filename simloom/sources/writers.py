"""Writers: the fingerprint table and the text forms of catalogue, pairs, clusters and co-clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.functions.scalar import similarity_text


def write_fingerprints(fps: DataFrame, path: str, mode: str = "overwrite", sort: bool = False, parts: int | None = None) -> None:
    """overwrite starts a store anew, append adds a batch; sort: by vid, for point reads."""
    if sort:
        fps = (fps.repartitionByRange(parts, "vid") if parts else fps.repartitionByRange("vid")).sortWithinPartitions("vid")
    fps.write.mode(mode).parquet(path)


def catalogue_lines(rows: DataFrame) -> DataFrame:
    """vid, path, nshred and nhash by tabs; a rejected sample has ``-`` for its vid. rows: vid, path, nshred, nhash, status."""
    vid = F.when(F.col("status") == "accepted", F.col("vid").cast("string")).otherwise("-")
    return rows.select(F.concat_ws("\t", vid, "path", F.coalesce("nshred", F.lit(0)).cast("string"), F.coalesce("nhash", F.lit(0)).cast("string")).alias("value"))


def pair_lines(pairs: DataFrame, style: str = "steps") -> DataFrame:
    """``a:b:0.123456:``, ``a:b:0.123:`` or ``sim<tab>:a:b:``."""
    sim, a, b = similarity_text(F.col("sim"), style), F.col("vid_a").cast("string"), F.col("vid_b").cast("string")
    if style == "hadoop":
        return pairs.select("vid_a", "vid_b", F.concat(similarity_text(F.col("sim"), "short"), F.lit("\t:"), a, F.lit(":"), b, F.lit(":")).alias("value"))
    return pairs.select("vid_a", "vid_b", F.concat(a, F.lit(":"), b, F.lit(":"), sim, F.lit(":")).alias("value"))


def parse_pairs(lines: DataFrame) -> DataFrame:
    """vid_a, vid_b and sim of ``a:b:sim:`` lines."""
    part = F.split("value", ":")
    return lines.select(part[0].cast("long").alias("vid_a"), part[1].cast("long").alias("vid_b"), part[2].cast("double").alias("sim"))


def cluster_lines(clusters: DataFrame, style: str = "single") -> DataFrame:
    """``C0: 1 2``, ``1: 1 2:2:`` or ``1:0 1 :2:``, a line for each cluster."""
    rows = clusters.groupBy("cid").agg(F.sort_array(F.collect_list("vid")).alias("v"))
    vids, cid, n = F.array_join(F.transform("v", lambda x: x.cast("string")), " "), F.col("cid").cast("string"), F.size("v").cast("string")
    forms = {"single": F.concat(F.lit("C"), cid, F.lit(": "), vids), "steps": F.concat(cid, F.lit(": "), vids, F.lit(":"), n, F.lit(":")), "openmp": F.concat(cid, F.lit(":"), vids, F.lit(" :"), n, F.lit(":"))}
    return rows.select("cid", forms[style].alias("value"))


def parse_clusters(lines: DataFrame) -> DataFrame:
    """cid and vid from any of the three forms."""
    cid = F.regexp_extract("value", r"^C?(\d+)", 1).cast("long")
    vids = F.filter(F.split(F.split("value", ":")[1], " "), lambda x: x != "")
    return lines.select(cid.alias("cid"), F.explode(vids).alias("v")).select("cid", F.col("v").cast("long").alias("vid"))


def label_line(labels: DataFrame, item: str, group: str) -> DataFrame:
    """All labels in the order of their items, by commas; for exports of moderate size."""
    return labels.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(item, group))), lambda x: x[group].cast("string")), ",").alias("value"))


def block_lines(blocks: DataFrame, k: int, l: int) -> DataFrame:  # noqa: E741
    """A line of l counts for each row group."""
    rows = blocks.groupBy("rg").agg(F.map_from_entries(F.collect_list(F.struct("cg", "n1"))).alias("m"))
    every = blocks.sparkSession.range(k).select(F.col("id").cast("int").alias("rg")).join(rows, "rg", "left")
    return every.select("rg", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(l - 1)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0)).cast("string")), ",").alias("value"))
