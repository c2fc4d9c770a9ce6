"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly. DataFrame functions only.

Words are runs of letters and digits of the lower-cased text; a shingle is ``k`` consecutive words. An item with fewer words is one
shingle of as many, which is looked for as such: documents have shingles of those lengths too, if there are such items. Items are partitioned by set size at powers of two. Every item of a
partition keeps a bottom MinHash sketch, its least shingle hashes, of the depth that the partition's largest size
needs: an item of n shingles of which a share ``t`` is in a document misses at most n - ceil(t n), so one of its
n - ceil(t n) + 1 least hashes is in the document, however long that is. Documents that hold a sketch hash of an item are its
candidates; only those are read again, and the share of the item's shingles that they hold is counted exactly.

Sketches and items are broadcast where their counted rows are within ``broadcast_rows`` and are shuffled beyond it.

Defined results: null and empty texts have no shingles and match nothing; a null id matches nothing (and
``decontaminated`` keeps it); rows that share an id are one document, rows that share an item id one item;
empty tables give no rows; other columns are never read by the search, and ``decontaminated`` returns all of the document's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm.common import broadcast_if, durable, read_table


def word_hashes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``w``, the hashes of its row's words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    hashed = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))
    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), hashed.alias("w"))


def shingles(w: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words; none if there are fewer."""
    every = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, (i + j).cast("int")) for j in range(k)]))
    return F.when(F.size(w) >= k, every).otherwise(F.array().cast("array<bigint>"))


def shingle_hashes(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """``key`` and ``g``, the distinct hashes of the shingles of all ``lengths`` of rows of word hashes."""
    grams = lambda w: F.array_distinct(F.concat(*(shingles(w, n) for n in lengths)))
    # The words are bound to a lambda variable: an alias would be inlined, and so computed anew, at each use.
    return rows.select("key", F.get(F.transform(F.array("w"), grams), F.lit(0)).alias("g"))


def item_hashes(rows: DataFrame, k: int) -> DataFrame:
    """``key`` and ``g`` of items: shingles of ``k`` words, or of as many as there are."""

    def grams(w: Column) -> Column:
        out = F.array().cast("array<bigint>")
        for n in range(1, k + 1):
            out = F.when(F.size(w) >= n, shingles(w, n)).otherwise(out)
        return out

    return rows.select("key", F.get(F.transform(F.array("w"), grams), F.lit(0)).alias("g"))


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, per_cent: int = 80, doc_col: str = "doc_id", item_col: str = "item_id", broadcast_rows: int = 2_000_000) -> DataFrame:
    """doc id, item id, n_item, n_shared and containment of every pair in which the document holds enough of the item."""
    item_words = durable(word_hashes(items, item_col, "text"))
    lengths = [k] + sorted(r[0] for r in item_words.select(F.size("w")).where((F.size("w") > 0) & (F.size("w") < k)).distinct().collect())
    shingled = item_hashes(item_words, k).select(F.col("key").alias("item"), F.explode("g").alias("h")).distinct()
    sets = durable(shingled.groupBy("item").agg(F.array_sort(F.collect_set("h")).alias("g")).withColumn("n_item", F.size("g").cast("long")))
    top = F.least(F.col("n_item"), F.pow(F.lit(2.0), F.floor(F.log2("n_item")) + 1).cast("long") - 1 - F.expr(f"ceil({per_cent} * (pow(2, floor(log2(n_item)) + 1) - 1) / 100)") + 1)
    sketches = durable(sets.select("item", F.explode(F.slice("g", 1, top.cast("int"))).alias("h")))
    members = sets.select("item", "n_item", F.explode("g").alias("h"))
    n_sketch, n_member = sketches.count(), members.count()

    probed = shingle_hashes(word_hashes(docs, doc_col, "text"), lengths).select("key", F.explode("g").alias("h"))
    candidates = durable(probed.join(broadcast_if(sketches, n_sketch, broadcast_rows), "h").select("key", "item").distinct())
    ids = candidates.select(F.col("key").alias(doc_col)).distinct()
    again = docs.select(doc_col, "text").join(broadcast_if(ids, candidates.count(), broadcast_rows), doc_col, "left_semi")
    held = shingle_hashes(word_hashes(again, doc_col, "text"), lengths).select("key", F.explode("g").alias("h")).join(broadcast_if(members, n_member, broadcast_rows), "h")
    shared = held.groupBy("key", "item", "n_item").agg(F.count_distinct("h").alias("n_shared")).join(candidates, ["key", "item"], "left_semi")
    found = shared.where(F.col("n_shared") * 100 >= F.col("n_item") * per_cent)
    return found.select(F.col("key").alias(doc_col), F.col("item").alias(item_col), "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, **how: object) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no item."""
    key = how.get("doc_col", "doc_id")
    found = durable(contained_items(docs, items, **how).select(key).distinct())
    return docs.join(broadcast_if(found, found.count(), 2_000_000), key, "left_anti").select(*docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
