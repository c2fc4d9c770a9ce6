"""Single-linkage clusters as connected components, their numbering, and precision and recall against a reference clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.common import settled
from simloom.operators.fingerprint import with_vids
from simloom.operators.similarity import similarity_links


def components(links: DataFrame) -> DataFrame:
    """id and component (its least id) of every id that a link (x, y) names, by alternating large-star and small-star rounds, each written
    out, until a round changes nothing."""
    edges = settled(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = settled(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").union(edges.select("v", "v").distinct())


def connected(vids: DataFrame, edges: DataFrame) -> DataFrame:
    """vid and root (the least vid of its component) of every vid."""
    found = components(edges.select(F.col("vid_a").alias("x"), F.col("vid_b").alias("y"))).select(F.col("id").alias("vid"), F.col("component").alias("root"))
    return vids.select("vid").join(found, "vid", "left").select("vid", F.coalesce("root", "vid").alias("root"))


def numbered(components: DataFrame, base: int = 0) -> DataFrame:
    """cid and vid: clusters in the order of their least member. Ranks are made from the roots alone."""
    roots = with_vids(components.where("vid = root").select("root"), "root", base).withColumnRenamed("vid", "cid")
    return components.join(roots, "root").select("cid", "vid")


def cluster(vids: DataFrame, pairs: DataFrame, t: float, base: int = 0, round_digits: int | None = None) -> DataFrame:
    """Clusters of stored pairs at a threshold; round_digits: compare the similarity as it was written with so many places."""
    sim = F.col("sim") if round_digits is None else F.round("sim", round_digits)
    return numbered(connected(vids, pairs.where(sim >= t)), base)


def similarity_clusters(fps: DataFrame, t: float, base: int = 0, **how: str) -> DataFrame:
    """Clusters of fingerprints within a threshold: as ``cluster`` of all their pairs, without a row for each pair of copies."""
    fps = settled(fps)
    return numbered(connected(fps.select("vid"), similarity_links(fps, t, **how)), base)


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cid").agg(F.count("*").alias("n"), F.min("vid").alias("first_vid"))


def size_histogram(clusters: DataFrame) -> DataFrame:
    return cluster_sizes(clusters).groupBy(F.col("n").alias("size")).agg(F.count("*").alias("clusters"))


def quality(reference: DataFrame, clusters: DataFrame) -> DataFrame:
    """precision: of each cluster its largest share of a reference class; recall: of each class its largest share of a cluster."""

    def best(of: DataFrame, other: DataFrame) -> DataFrame:
        overlap = of.select(F.col("cid").alias("a"), "vid").join(other.select(F.col("cid").alias("b"), "vid"), "vid").groupBy("a", "b").agg(F.count("*").alias("n"))
        hit = overlap.groupBy("a").agg(F.max("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hit"))
        return hit.join(F.broadcast(of.agg(F.count("*").alias("all")))).select(F.round(F.try_divide(F.col("hit"), F.col("all")), 5).alias("share"))

    precision, recall = best(clusters, reference).toDF("precision"), best(reference, clusters).toDF("recall")
    return precision.join(F.broadcast(recall))


def cluster_tree(clusters: DataFrame, names: DataFrame) -> DataFrame:
    """One XML branch for each cluster, its samples' names and labels joined in. names: vid, name, vlabel. Escapes markup."""

    def quoted(c: str):
        return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))

    leaf = F.concat(F.lit('<leaf name="'), quoted("name"), F.lit('" vlabel="'), quoted("vlabel"), F.lit('"/>'))
    rows = clusters.join(names, "vid").select("cid", "vid", leaf.alias("leaf")).groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("vid", "leaf"))).alias("x"))
    return rows.select("cid", F.concat(F.format_string('<branch name="%d">', F.col("cid")), F.array_join(F.transform("x", lambda v: v["leaf"]), ""), F.lit("</branch>")).alias("xml"))


def search(names: DataFrame, text: str) -> DataFrame:
    return names.where(F.col("name").contains(text) | F.col("vlabel").contains(text))
