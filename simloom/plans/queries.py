"""Queries over the driver's tables, one for each operator, and their DuckDB SQL."""

from __future__ import annotations

import dataclasses
import struct
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.common import settled, shared_dir

from simloom.functions.hashing import hash_column
from simloom.functions.scalar import short_name
from simloom.operators import clustering as cl
from simloom.operators import cocluster as cc
from simloom.operators import fingerprint as fp
from simloom.operators import similarity as sim
from simloom.params import PRESETS, Params
from simloom.sources import readers as rd
from simloom.sources import writers as wr

TEXT = PRESETS["single_text"]
BYTES = PRESETS["openmp"]
SMALL = Params(fp_bits=256)
MATRIX = Params(shred_size=1, fp_bits=256, max_set_ratio=None)
K, L = 3, 4


def samples(spark: SparkSession, d: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet").select(F.col(key).alias("vid"), F.col(text).alias("data"))


def prints(spark: SparkSession, d: str, params: Params = TEXT, mode: str = "text") -> DataFrame:
    return fp.accepted(fp.fingerprints(samples(spark, d), params, mode), params)


def line_hash(spark: SparkSession, d: str) -> DataFrame:
    return fp.exploded(fp.shreds(samples(spark, d), TEXT))


def line_shred_s3(spark: SparkSession, d: str) -> DataFrame:
    return fp.exploded(fp.shreds(samples(spark, d), Params(shred_size=3)))


def other_hash(kind: str):
    return lambda spark, d: fp.exploded(fp.shreds(samples(spark, d), TEXT, kind=kind))


def column_hash(spark: SparkSession, d: str) -> DataFrame:
    """All three hashes of the benchmark items' whole texts as Column expressions."""
    data = F.encode("data", "utf-8")
    return samples(spark, d, "benchmark", "item_id").select("vid", *(hash_column(data, k).alias(k) for k in ("djb2", "sdbm", "jenkins")))


def byte_shred(spark: SparkSession, d: str) -> DataFrame:
    h = "hashes"
    return fp.shreds(samples(spark, d), BYTES, "bytes").select("vid", "nshred", F.aggregate(h, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("hash_sum"), F.coalesce(F.array_max(h), F.lit(0)).alias("hash_max"), F.coalesce(F.array_min(h), F.lit(0)).alias("hash_min"))


def page_shred(spark: SparkSession, d: str) -> DataFrame:
    h = "hashes"
    return fp.shreds(samples(spark, d, "pages", "page_id", "html"), BYTES, "bytes").select("vid", "nshred", F.aggregate(h, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("hash_sum"), F.coalesce(F.array_max(h), F.lit(0)).alias("hash_max"), F.coalesce(F.array_min(h), F.lit(0)).alias("hash_min"))


def winnow_select(spark: SparkSession, d: str) -> DataFrame:
    return fp.exploded(fp.shreds(samples(spark, d), Params(shred_size=1, window_size=4), keep="winnowed"))


def winnow_frame(spark: SparkSession, d: str) -> DataFrame:
    return fp.winnowed_rows(fp.exploded(fp.shreds(samples(spark, d), TEXT)), 4)


def fingerprint_stats(spark: SparkSession, d: str) -> DataFrame:
    return fp.fingerprints(samples(spark, d), TEXT).select("vid", "nshred", "nhash", "nbits")


def byte_fingerprint_stats(spark: SparkSession, d: str) -> DataFrame:
    return fp.fingerprints(samples(spark, d), BYTES, "bytes").select("vid", "nshred", "nhash", "nbits")


def density_filter(spark: SparkSession, d: str) -> DataFrame:
    own = samples(spark, d)
    return fp.catalogue(own, fp.fingerprints(own, SMALL, "bytes"), SMALL)


def small_samples(spark: SparkSession, d: str) -> DataFrame:
    """Short turns of conversations, many of which have too few lines for a window."""
    own = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("vid"), F.col("text").alias("data"))
    params = Params(shred_size=1, window_size=3)
    return fp.catalogue(own, fp.fingerprints(own, params), params)


def dense_vids(spark: SparkSession, d: str) -> DataFrame:
    """Dense ids of accepted samples in the order of their ids."""
    own = samples(spark, d)
    return fp.with_vids(fp.accepted(fp.fingerprints(own, SMALL, "bytes"), SMALL).select(F.col("vid").alias("doc_id"), "nbits"), "doc_id", 1)


def vinfo(spark: SparkSession, d: str) -> DataFrame:
    return fp.vinfo(prints(spark, d), 7, TEXT)


def zero_columns(spark: SparkSession, d: str) -> DataFrame:
    return fp.zero_columns(prints(spark, d), TEXT)


def run_statistics(spark: SparkSession, d: str) -> DataFrame:
    own = samples(spark, d)
    return fp.run_statistics(own, fp.fingerprints(own, TEXT))


def dump_ascii(spark: SparkSession, d: str) -> DataFrame:
    return fp.ascii_matrix(fp.fingerprints(samples(spark, d), MATRIX), MATRIX)


def dense_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints written as dense bytes and read back."""
    own = fp.dense(fp.fingerprints(samples(spark, d), MATRIX), MATRIX)
    return fp.from_dense(own, MATRIX, "vid", "fp").select("vid", "nbits", F.array_join("bits", ",").alias("bits"))


def rounded(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("sim", F.round("sim", 6))


def joined(measure: str, t: float = 0.6, numeric: str = "exact"):
    return lambda spark, d: rounded(sim.similarity_join(prints(spark, d), t, measure, numeric))


def byte_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sim.similarity_join(prints(spark, d, BYTES, "bytes"), BYTES.threshold))


def pairs_all(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sim.all_pairs(fp.fingerprints(samples(spark, d, "benchmark", "item_id"), Params(), "bytes")))


def pairs_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with their rank: range partitions are sorted, and each is offset by the pairs before it."""
    pairs = settled(rounded(sim.similarity_join(prints(spark, d), 0.5)))
    return fp.with_vids(pairs, ["sim", "vid_a", "vid_b"], 1, "rank", sim.partitions(spark, pairs.count() / sim.TASK_ROWS))


def pairs_incremental(spark: SparkSession, d: str) -> DataFrame:
    own = prints(spark, d)
    half = spark.read.parquet(f"{d}/documents.parquet").count() // 2
    return rounded(sim.incremental_join(own, half, 0.6))


def nearest_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """The nearest document of every benchmark item, by byte shreds."""
    asked = fp.fingerprints(samples(spark, d, "benchmark", "item_id"), BYTES, "bytes")
    return sim.nearest(asked, fp.fingerprints(samples(spark, d), BYTES, "bytes")).withColumn("sim", F.round("sim", 6))


def clustered(spark: SparkSession, d: str) -> DataFrame:
    return cl.similarity_clusters(prints(spark, d), 0.6)


def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return cl.cluster_sizes(clustered(spark, d))


def size_histogram(spark: SparkSession, d: str) -> DataFrame:
    return cl.size_histogram(clustered(spark, d))


def recluster_08(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of stored pairs at a higher threshold than they were found at."""
    own = settled(prints(spark, d))
    return cl.cluster(own.select("vid"), sim.similarity_join(own, 0.6), 0.8)


def quality_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    reference = spark.read.parquet(f"{d}/documents.parquet").select(F.col("lang").alias("cid"), F.col("doc_id").alias("vid"))
    return cl.quality(reference, clustered(spark, d))


def cdb_text(spark: SparkSession, d: str) -> DataFrame:
    return wr.cluster_lines(clustered(spark, d), "steps")


def jdb_text(spark: SparkSession, d: str) -> DataFrame:
    return wr.pair_lines(sim.similarity_join(prints(spark, d), 0.6), "openmp")


def cluster_tree(spark: SparkSession, d: str) -> DataFrame:
    names = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("vid"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("vlabel"))
    return cl.cluster_tree(clustered(spark, d), names)


def vdb_list(spark: SparkSession, d: str) -> DataFrame:
    own = samples(spark, d)
    rows = fp.catalogue(own, fp.fingerprints(own, SMALL, "bytes"), SMALL).withColumn("path", F.concat(F.lit("doc"), F.col("vid").cast("string")))
    return wr.catalogue_lines(rows)


def grid(spark: SparkSession, d: str) -> tuple[DataFrame, cc.State]:
    own = fp.fingerprints(samples(spark, d), MATRIX)
    vids = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("vid"))
    return settled(fp.postings(own).select("vid", "bit")), cc.initial(spark, vids, MATRIX.fp_bits, K, L, seed=None)


def cc_init_g(spark: SparkSession, d: str) -> DataFrame:
    post, s = grid(spark, d)
    return cc.block_counts(post, s.r, s.c)


def cc_row_stats(spark: SparkSession, d: str) -> DataFrame:
    post, s = grid(spark, d)
    return cc.line_statistics(post, s.c, "vid", "bit", "cg")


def cc_row_step(spark: SparkSession, d: str) -> DataFrame:
    post, s = grid(spark, d)
    return cc.row_pass(post, s).r


def cc_col_step(spark: SparkSession, d: str) -> DataFrame:
    post, s = grid(spark, d)
    return cc.column_pass(post, s).c


def cc_cost(spark: SparkSession, d: str) -> DataFrame:
    post, s = grid(spark, d)
    return spark.createDataFrame([(round(cc.cost_of(post, s), 3), round(cc.cost_of(post, s, "content"), 3))], "cost double, content_nats double")


def cc_split_labels(spark: SparkSession, d: str) -> DataFrame:
    post, s = grid(spark, d)
    return cc.split(post, s, "row", 1).r


def cc_permute(spark: SparkSession, d: str) -> DataFrame:
    post, s = grid(spark, d)
    return cc.permute(post, s).c


def cc_merge(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d)[1].r


def cc_rowgroup_listing(spark: SparkSession, d: str) -> DataFrame:
    _, s = grid(spark, d)
    names = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("vid"), F.col("source").alias("name"))
    return cc.row_group_listing(s.r, names)


def cc_coordinates(spark: SparkSession, d: str) -> DataFrame:
    return cc.coordinates(*grid(spark, d))


def cc_dominant(spark: SparkSession, d: str) -> DataFrame:
    _, s = grid(spark, d)
    first, rest = cc.dominant_and_others(fp.fingerprints(samples(spark, d), MATRIX), s.r)
    return first.select("vid", F.size("bits").alias("first_bits")).join(rest.select("vid", F.size("bits").alias("other_bits")), "vid")


def cc_features(spark: SparkSession, d: str) -> DataFrame:
    _, s = grid(spark, d)
    return cc.feature_listing(fp.exploded(fp.shreds(samples(spark, d), MATRIX)), s.c, 7, MATRIX.fp_bits)


def cc_refine(spark: SparkSession, d: str) -> DataFrame:
    post, s = grid(spark, d)
    return cc.refine(post, s)[0].r


def multi_hash_stats(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints that two hash functions set bits of."""
    return fp.fingerprints(samples(spark, d), dataclasses.replace(TEXT, hashes=("djb2", "sdbm"))).select("vid", "nshred", "nhash", "nbits")


def little(n: Column) -> Column:
    """An integer column as four bytes, the lowest first."""
    digits = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*(F.substring(digits, i, 2) for i in (7, 5, 3, 1))))


def executables(spark: SparkSession, d: str) -> DataFrame:
    """An executable of three sections made from each document: data, code around the entry point (the text), and a section named as code
    (the text with capital vowels). Documents without a text give none."""
    head = b"MZ" + b"\0" * 58 + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HH", 0x14C, 3) + b"\0" * 12 + struct.pack("<HH", 32, 0) + (b"\0" * 16 + struct.pack("<I", 0x10000000)).ljust(32, b"\0")
    text, capitals = F.encode("data", "utf-8"), F.encode(F.translate("data", "aeiou", "AEIOU"), "utf-8")
    at, n, m = len(head) + 3 * 40, F.octet_length(text), F.octet_length(capitals)

    def section(name: bytes, va: int, size: Column, where: Column, flags: int) -> Column:
        return F.concat(F.lit(name.ljust(8, b"\0")), little(size), F.lit(struct.pack("<I", va)), little(size), little(where), F.lit(b"\0" * 12 + struct.pack("<I", flags)))

    table = F.concat(section(b".data", 0x40000000, F.lit(16), F.lit(at), 0x40), section(b"own", 0x10000000, n, F.lit(at + 16), 0x20), section(b".text", 0x20000000, m, F.lit(at + 16) + n, 0x20))
    return samples(spark, d).select("vid", F.concat(F.lit(head), table, F.lit(b"d" * 16), text, capitals).alias("data"))


def pe_fingerprint_stats(spark: SparkSession, d: str) -> DataFrame:
    """From executables to fingerprints of their entry sections."""
    own = rd.executable_samples(executables(spark, d), "entry", id_col="vid", data_col="data")
    return fp.fingerprints(own, BYTES, "bytes").select("vid", "nshred", "nhash", "nbits")


def pe_both_sections(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of all code sections; shreds never cross sections."""
    own = rd.executable_samples(executables(spark, d), "entry_or_named", id_col="vid", data_col="data")
    return fp.fingerprints(own, Params(), "bytes").select("vid", "nshred", "nhash", "nbits")


def pe_pairs(spark: SparkSession, d: str) -> DataFrame:
    own = rd.executable_samples(executables(spark, d), "named", id_col="vid", data_col="data")
    return rounded(sim.similarity_join(fp.fingerprints(own, BYTES, "bytes"), BYTES.threshold))


def point_read(spark: SparkSession, d: str) -> DataFrame:
    """Two fingerprints of a stored table that is sorted by vid."""
    path = f"{shared_dir(spark)}/simloom/{uuid.uuid4().hex}"
    wr.write_fingerprints(prints(spark, d), path, sort=True)
    return rd.read_fingerprints(spark, path, [7, 11]).select("vid", "nshred", "nbits", F.array_join("bits", ",").alias("bits"))


def short_names(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", short_name(F.col("url")).alias("name"))


def name_search(spark: SparkSession, d: str) -> DataFrame:
    names = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("vid"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("vlabel"))
    return cl.search(names, "c1")


def cdb_style(style: str):
    return lambda spark, d: wr.cluster_lines(clustered(spark, d), style)


def jdb_style(style: str):
    return lambda spark, d: wr.pair_lines(sim.similarity_join(prints(spark, d), 0.6), style)


def cc_split_columns(spark: SparkSession, d: str) -> DataFrame:
    post, s = grid(spark, d)
    return cc.split(post, s, "col", 2).c


def merged(spark: SparkSession, d: str) -> tuple[DataFrame, cc.State]:
    post, a = grid(spark, d)
    cuts = cc.even_cuts(a.r.count(), 2)
    b = cc.State(a.r.select("vid", cc.cut_label(F.col("vid"), cuts).alias("rg")), a.c.select("bit", (F.col("bit") % 3).alias("cg")), 2, 3)
    return cc.merge(a, b, post.where("bit < 200"), post.where("bit >= 100"))


def cc_dump_r(spark: SparkSession, d: str) -> DataFrame:
    return wr.label_line(grid(spark, d)[1].r, "vid", "rg")


def cc_dump_c(spark: SparkSession, d: str) -> DataFrame:
    return wr.label_line(grid(spark, d)[1].c, "bit", "cg")


def cc_dump_g(spark: SparkSession, d: str) -> DataFrame:
    post, s = grid(spark, d)
    return wr.block_lines(cc.block_counts(post, s.r, s.c), s.k, s.l)


def cc_search(spark: SparkSession, d: str) -> DataFrame:
    """The outer search from samples on, over the benchmark's items."""
    own = fp.fingerprints(samples(spark, d, "benchmark", "item_id"), dataclasses.replace(MATRIX, shred_size=4, fp_bits=64), "bytes")
    return cc.cocluster(own, 64, 2, 2, seed=3)[0]


def cc_grid(spark: SparkSession, d: str) -> DataFrame:
    own = fp.fingerprints(samples(spark, d, "benchmark", "item_id"), dataclasses.replace(MATRIX, shred_size=4, fp_bits=32), "bytes")
    return cc.cocluster(own, 32, 2, 2, seed=3, how="grid")[0]


QUERIES = {
    "line_hash": line_hash, "line_shred_s3": line_shred_s3, "sdbm_hash": other_hash("sdbm"), "jenkins_hash": other_hash("jenkins"), "column_hash": column_hash, "byte_shred": byte_shred, "page_shred": page_shred,
    "winnow_select": winnow_select, "winnow_frame": winnow_frame, "fingerprint_stats": fingerprint_stats, "byte_fingerprint_stats": byte_fingerprint_stats, "density_filter": density_filter, "small_samples": small_samples,
    "dense_vids": dense_vids, "vinfo": vinfo, "zero_columns": zero_columns, "run_statistics": run_statistics, "dump_ascii": dump_ascii, "dense_round_trip": dense_round_trip,
    "pairs_jaccard": joined("jaccard"), "pairs_float32": joined("jaccard", 0.7, "float32"), "pairs_containment": joined("containment"), "pairs_harmony": joined("harmony"), "byte_pairs": byte_pairs, "pairs_all": pairs_all, "pairs_sorted": pairs_sorted,
    "pairs_incremental": pairs_incremental, "nearest_benchmark": nearest_benchmark, "clusters": clustered, "cluster_sizes": cluster_sizes, "size_histogram": size_histogram, "recluster_08": recluster_08,
    "quality_precision_recall": quality_precision_recall, "cdb_text": cdb_text, "jdb_text": jdb_text, "cluster_tree": cluster_tree, "vdb_list": vdb_list,
    "cc_init_g": cc_init_g, "cc_row_stats": cc_row_stats, "cc_row_step": cc_row_step, "cc_col_step": cc_col_step, "cc_cost": cc_cost, "cc_split_labels": cc_split_labels, "cc_permute": cc_permute, "cc_merge": cc_merge,
    "cc_rowgroup_listing": cc_rowgroup_listing, "cc_coordinates": cc_coordinates, "cc_dominant": cc_dominant, "cc_features": cc_features, "cc_refine": cc_refine, "cc_search": cc_search, "cc_grid": cc_grid,
    "multi_hash_stats": multi_hash_stats, "pe_fingerprint_stats": pe_fingerprint_stats, "pe_both_sections": pe_both_sections, "pe_pairs": pe_pairs, "point_read": point_read, "short_names": short_names, "name_search": name_search,
    "cdb_single": cdb_style("single"), "cdb_openmp": cdb_style("openmp"), "jdb_steps": jdb_style("steps"), "jdb_hadoop": jdb_style("hadoop"),
    "cc_split_columns": cc_split_columns, "cc_merge_columns": lambda spark, d: merged(spark, d)[1].c, "cc_merge_bits": lambda spark, d: merged(spark, d)[0], "cc_dump_r": cc_dump_r, "cc_dump_c": cc_dump_c, "cc_dump_g": cc_dump_g,
}

M = 4294967295
BYTE_LIST = "list_transform(range(0, len(h) // 2), lambda q: ('0x' || h[2 * q + 1 : 2 * q + 2])::BIGINT)"
HASH = {
    "djb2": f"list_reduce(list_prepend(5381::BIGINT, b), lambda a, c: (a * 33 + c) & {M})",
    "sdbm": f"list_reduce(list_prepend(0::BIGINT, b), lambda a, c: (a * 65599 + c) & {M})",
    "jenkins": f"list_reduce(list_prepend(0::BIGINT, b), lambda a, c: xor((((a + c) & {M}) * 1025) & {M}, ((((a + c) & {M}) * 1025) & {M}) >> 6))",
}
LINES = f"""parts AS (SELECT doc_id AS vid, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
    lines AS (SELECT vid, i, hex(encode(p[i])) || CASE WHEN i < len(p) THEN '0A' ELSE '' END AS x FROM (SELECT vid, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
    pieces AS (SELECT vid, i, j, x[j * {2 * fp.LINE_BYTES} + 1 : (j + 1) * {2 * fp.LINE_BYTES}] AS h FROM (SELECT vid, i, x, unnest(range(0, (len(x) + {2 * fp.LINE_BYTES - 1}) // {2 * fp.LINE_BYTES})) AS j FROM lines)),
    numbered AS (SELECT vid, row_number() OVER (PARTITION BY vid ORDER BY i, j) - 1 AS pos, h FROM pieces)"""


def line_hashes(kind: str = "djb2", size: int = 1) -> str:
    joined_lines = "h" if size == 1 else "h || " + " || ".join(f"lead(h, {j}) OVER (PARTITION BY vid ORDER BY pos)" for j in range(1, size))
    end = "a" if kind != "jenkins" else f"(xor((a * 9) & {M}, ((a * 9) & {M}) >> 11) * 32769) & {M}"
    return f"""{LINES}, runs AS (SELECT vid, pos, {joined_lines} AS h FROM numbered), raw AS (SELECT vid, pos, {BYTE_LIST} AS b FROM runs WHERE h IS NOT NULL),
    shreds AS (SELECT vid, pos, {end} AS hash FROM (SELECT vid, pos, {HASH[kind]} AS a FROM raw))"""


def byte_hashes(size: int, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    total = " + ".join(["b * " + str(pow(33, size - 1, 1 << 32)), *(f"lead(b, {j}) OVER w * {pow(33, size - 1 - j, 1 << 32)}" for j in range(1, size))])
    return f"""texts AS (SELECT {key} AS vid, hex(encode({text})) AS x FROM {table} WHERE {text} IS NOT NULL),
    bytes AS (SELECT vid, pos, ('0x' || x[2 * pos + 1 : 2 * pos + 2])::BIGINT AS b FROM (SELECT vid, x, unnest(range(0, len(x) // 2)) AS pos FROM texts)),
    shreds AS (SELECT vid, pos, hash FROM (SELECT vid, pos, ({5381 * pow(33, size, 1 << 32) % (1 << 32)} + {total}) & {M} AS hash FROM bytes WINDOW w AS (PARTITION BY vid ORDER BY pos)) WHERE hash IS NOT NULL)"""


def winnowed(window: int) -> str:
    return f"""keyed AS (SELECT vid, min(hash * 4194304 + 4194303 - pos) OVER f AS m, count(*) OVER f AS n FROM shreds WINDOW f AS (PARTITION BY vid ORDER BY pos ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)),
    chosen AS (SELECT DISTINCT vid, 4194303 - m % 4194304 AS pos, m // 4194304 AS hash FROM keyed WHERE n = {window})"""


STATS = "SELECT vid, any_value(nshred) AS nshred, count(*) AS nhash, count(DISTINCT hash & {mask}) AS nbits FROM {rows} JOIN (SELECT vid, count(*) AS nshred FROM shreds GROUP BY vid) USING (vid) GROUP BY vid"


def bit_rows(params: Params = TEXT, source: str = "") -> str:
    """CTEs up to bits(vid, bit) and sizes(vid, n) of accepted samples."""
    most = f"HAVING count(*) <= {params.fp_bits * params.max_set_ratio}" if params.max_set_ratio is not None else ""
    rows = "chosen" if params.window_size > 1 else "shreds"
    return f"""{source or line_hashes()}, every AS (SELECT DISTINCT vid, hash & {params.fp_bits - 1} AS bit FROM {rows}), sizes AS (SELECT vid, count(*) AS n FROM every GROUP BY vid {most}), bits AS (SELECT vid, bit FROM every SEMI JOIN sizes USING (vid))"""


def pair_rows(t: float, measure: str = "jaccard", numeric: str = "exact", bits: str = "") -> str:
    kinds = {"jaccard": "c / (p.n + q.n - c)", "containment": "c / least(p.n, q.n)"}
    kinds["harmony"] = f"CASE WHEN p.n = q.n THEN {kinds['jaccard']} ELSE {kinds['containment']} END"
    value = f"({kinds[measure]})::FLOAT::DOUBLE" if numeric == "float32" else kinds[measure]
    return f"""{bits or bit_rows()}, shared AS (SELECT a.vid AS vid_a, b.vid AS vid_b, count(*) AS c FROM bits a JOIN bits b ON a.bit = b.bit AND a.vid < b.vid GROUP BY 1, 2),
    pairs AS (SELECT vid_a, vid_b, c AS inter, p.n + q.n - c AS uni, {kinds[measure]} AS sim FROM shared JOIN sizes p ON p.vid = vid_a JOIN sizes q ON q.vid = vid_b WHERE {value} >= {t})"""


def cluster_rows(t: float = 0.6) -> str:
    return f"""{pair_rows(0.6)}, links AS (SELECT vid_a AS x, vid_b AS y FROM pairs WHERE sim >= {t} UNION ALL SELECT vid_b, vid_a FROM pairs WHERE sim >= {t}),
    reach AS (SELECT vid AS a, vid AS b FROM sizes UNION SELECT a, y FROM reach JOIN links ON b = x), roots AS (SELECT a AS vid, min(b) AS root FROM reach GROUP BY a),
    clusters AS (SELECT vid, dense_rank() OVER (ORDER BY root) - 1 AS cid FROM roots)"""


PAIRS = "SELECT vid_a, vid_b, inter, uni, round(sim, 6) AS sim FROM pairs"
BYTE_SOURCE = f"{byte_hashes(16)}, {winnowed(12)}"
SMALL_BITS = bit_rows(dataclasses.replace(SMALL, max_set_ratio=None), byte_hashes(4))
CATALOGUE = f"""{SMALL_BITS}, rows AS (SELECT vid, nshred, nhash, s.n AS nbits, CASE WHEN s.n IS NULL THEN 'too_small' WHEN s.n > {256 * 0.7} THEN 'too_dense' ELSE 'accepted' END AS status
    FROM (SELECT doc_id AS vid FROM documents) LEFT JOIN sizes s USING (vid) LEFT JOIN (SELECT vid, count(*) AS nshred, count(*) AS nhash FROM shreds GROUP BY vid) USING (vid))"""


def cut_sql(index: str, n: str, groups: int) -> str:
    return " + ".join(f"({index} >= {n} * {i} // {groups})::INT" for i in range(1, groups))


def ent(a: str, n: str) -> str:
    return f"CASE WHEN ({a}) > 0 AND ({n}) - ({a}) > 0 THEN ({a}) * log2(({n})::DOUBLE / ({a})) + (({n}) - ({a})) * log2(({n})::DOUBLE / (({n}) - ({a}))) ELSE 0 END"


TURNS = f"{line_hashes().replace('doc_id AS vid', 'conv_id * 1000 + turn AS vid').replace('FROM documents', 'FROM conversations')}, {winnowed(3)}"


def both_cases(size: int) -> str:
    return byte_hashes(size, "(SELECT doc_id * 2 AS k, text FROM documents UNION ALL SELECT doc_id * 2 + 1, translate(text, 'aeiou', 'AEIOU') FROM documents)", "k")


GRID = f"""{bit_rows(MATRIX)}, total AS (SELECT count(*) AS n FROM documents), r AS (SELECT doc_id AS vid, {cut_sql('doc_id', 'n', K)} AS rg FROM documents, total),
    c AS (SELECT i AS bit, {cut_sql('i', '256', L)} AS cg FROM range(0, 256) t(i)), rs AS (SELECT rg, count(*) AS m FROM r GROUP BY rg), cs AS (SELECT cg, count(*) AS m FROM c GROUP BY cg),
    ones AS (SELECT rg, cg, count(*) AS n1 FROM bits JOIN r USING (vid) JOIN c USING (bit) GROUP BY 1, 2),
    g AS (SELECT rg, cg, rs.m AS rm, cs.m AS cm, coalesce(n1, 0) AS n1 FROM rs CROSS JOIN cs LEFT JOIN ones USING (rg, cg))"""


def step_sql(item: str, by: str, mine: str, theirs: str, labels: str, others: str, own: str, other: str) -> str:
    return f"""WITH {GRID}, st AS (SELECT i.{item} AS x, i.{mine} AS cur, o.{theirs} AS j, coalesce(n, 0) AS n FROM {labels} i CROSS JOIN (SELECT DISTINCT {theirs} FROM {others}) o
        LEFT JOIN (SELECT {item}, {theirs}, count(*) AS n FROM bits JOIN {others} USING ({by}) GROUP BY 1, 2) z ON z.{item} = i.{item} AND z.{theirs} = o.{theirs}),
    before AS (SELECT {mine} AS a, sum({ent('n1', f'{own} * {other}')}) AS e FROM g GROUP BY 1),
    leaving AS (SELECT x, cur, sum({ent('n1 - n', f'({own} - 1) * {other}')}) AS e FROM st JOIN g ON g.{mine} = cur AND g.{theirs} = j GROUP BY 1, 2),
    joining AS (SELECT x, cur, g.{mine} AS cand, sum({ent('n1 + n', f'({own} + 1) * {other}')}) AS e FROM st JOIN g ON g.{theirs} = j GROUP BY 1, 2, 3),
    change AS (SELECT q.x, q.cand, CASE WHEN q.cand = q.cur THEN 0 ELSE round(l.e - p.e + q.e - b.e, 6) END AS d FROM joining q JOIN leaving l ON l.x = q.x JOIN before p ON p.a = q.cur JOIN before b ON b.a = q.cand),
    best AS (SELECT x, cand, row_number() OVER (PARTITION BY x ORDER BY d, cand) AS k FROM change)
    SELECT x AS {item}, (dense_rank() OVER (ORDER BY cand) - 1)::INT AS {mine} FROM best WHERE k = 1"""


SIZE_BITS = " + ".join(f"coalesce((SELECT sum(ceil(log2(tail - (cnt - 1) + k - 1))) FROM (SELECT row_number() OVER (ORDER BY m DESC) AS k, sum(m) OVER (ORDER BY m DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail, count(*) OVER () AS cnt FROM {t}) WHERE k < cnt), 0)" for t in ("rs", "cs"))

ORACLE_SQL = {
    "line_hash": f"WITH {line_hashes()} SELECT vid, pos, hash FROM shreds",
    "line_shred_s3": f"WITH {line_hashes(size=3)} SELECT vid, pos, hash FROM shreds",
    "sdbm_hash": f"WITH {line_hashes('sdbm')} SELECT vid, pos, hash FROM shreds",
    "jenkins_hash": f"WITH {line_hashes('jenkins')} SELECT vid, pos, hash FROM shreds",
    "column_hash": f"WITH x AS (SELECT item_id AS vid, {BYTE_LIST} AS b FROM (SELECT item_id, hex(encode(text)) AS h FROM benchmark)), y AS (SELECT vid, {HASH['djb2']} AS djb2, {HASH['sdbm']} AS sdbm, {HASH['jenkins']} AS a FROM x) SELECT vid, djb2, sdbm, (xor((a * 9) & {M}, ((a * 9) & {M}) >> 11) * 32769) & {M} AS jenkins FROM y",
    "byte_shred": f"WITH {byte_hashes(16)} SELECT doc_id AS vid, count(hash) AS nshred, coalesce(sum(hash), 0)::BIGINT AS hash_sum, coalesce(max(hash), 0) AS hash_max, coalesce(min(hash), 0) AS hash_min FROM documents LEFT JOIN shreds ON vid = doc_id GROUP BY doc_id",
    "page_shred": f"WITH {byte_hashes(16, 'pages', 'page_id', 'html')} SELECT page_id AS vid, count(hash) AS nshred, coalesce(sum(hash), 0)::BIGINT AS hash_sum, coalesce(max(hash), 0) AS hash_max, coalesce(min(hash), 0) AS hash_min FROM pages LEFT JOIN shreds ON vid = page_id GROUP BY page_id",
    "winnow_select": f"WITH {line_hashes()}, {winnowed(4)} SELECT vid, pos, hash FROM chosen",
    "winnow_frame": f"WITH {line_hashes()}, {winnowed(4)} SELECT vid, pos, hash FROM chosen",
    "fingerprint_stats": f"WITH {line_hashes()} " + STATS.format(mask=TEXT.fp_bits - 1, rows="shreds"),
    "byte_fingerprint_stats": f"WITH {BYTE_SOURCE} " + STATS.format(mask=BYTES.fp_bits - 1, rows="chosen"),
    "density_filter": f"WITH {CATALOGUE} SELECT * FROM rows",
    "dense_vids": f"WITH {CATALOGUE} SELECT row_number() OVER (ORDER BY vid) AS vid, vid AS doc_id, nbits FROM rows WHERE status = 'accepted'",
    "vdb_list": f"WITH {CATALOGUE} SELECT concat_ws(chr(9), CASE WHEN status = 'accepted' THEN vid::VARCHAR ELSE '-' END, 'doc' || vid, coalesce(nshred, 0)::VARCHAR, coalesce(nhash, 0)::VARCHAR) AS value FROM rows",
    "vinfo": f"WITH {bit_rows()} SELECT vid, n AS n_set, {TEXT.fp_bits} - n AS n_clear FROM sizes WHERE vid = 7",
    "zero_columns": f"WITH {bit_rows()} SELECT {TEXT.fp_bits} - count(DISTINCT bit) AS zero_columns FROM bits",
    "run_statistics": f"WITH {bit_rows(MATRIX)}, fine AS (SELECT vid, count(DISTINCT hash & {TEXT.fp_bits - 1}) AS nbits FROM shreds GROUP BY vid) SELECT (SELECT count(*) FROM documents) AS samples, (SELECT sum(octet_length(encode(text)))::BIGINT FROM documents) AS bytes, (SELECT count(*) FROM fine) AS fingerprinted, (SELECT count(*) FROM shreds) AS nshred, (SELECT sum(nbits)::BIGINT FROM fine) AS nbits",
    "dump_ascii": f"WITH {bit_rows(MATRIX)}, cells AS (SELECT s.vid, i, (SELECT 1) AS one FROM sizes s CROSS JOIN range(0, 256) t(i)) SELECT c.vid, string_agg(CASE WHEN b.bit IS NULL THEN '0' ELSE '1' END, '' ORDER BY i) AS line FROM cells c LEFT JOIN bits b ON b.vid = c.vid AND b.bit = c.i GROUP BY c.vid",
    "dense_round_trip": f"WITH {bit_rows(MATRIX)} SELECT vid, count(*) AS nbits, string_agg(bit::VARCHAR, ',' ORDER BY bit) AS bits FROM bits GROUP BY vid",
    "pairs_jaccard": f"WITH {pair_rows(0.6)} {PAIRS}",
    "pairs_float32": f"WITH {pair_rows(0.7, numeric='float32')} {PAIRS}",
    "pairs_containment": f"WITH {pair_rows(0.6, 'containment')} {PAIRS}",
    "pairs_harmony": f"WITH {pair_rows(0.6, 'harmony')} {PAIRS}",
    "byte_pairs": f"WITH {pair_rows(0.7, bits=bit_rows(BYTES, BYTE_SOURCE))} {PAIRS}",
    "pairs_all": f"""WITH {bit_rows(dataclasses.replace(TEXT, max_set_ratio=None), byte_hashes(4, 'benchmark', 'item_id'))}, shared AS (SELECT a.vid AS vid_a, b.vid AS vid_b, count(*) AS c FROM bits a JOIN bits b ON a.bit = b.bit AND a.vid < b.vid GROUP BY 1, 2)
        SELECT p.vid AS vid_a, q.vid AS vid_b, coalesce(c, 0) AS inter, p.n + q.n - coalesce(c, 0) AS uni, round(coalesce(c, 0) / (p.n + q.n - coalesce(c, 0)), 6) AS sim FROM sizes p JOIN sizes q ON p.vid < q.vid LEFT JOIN shared s ON s.vid_a = p.vid AND s.vid_b = q.vid""",
    "pairs_sorted": f"WITH {pair_rows(0.5)} SELECT vid_a, vid_b, inter, uni, round(sim, 6) AS sim, row_number() OVER (ORDER BY round(sim, 6), vid_a, vid_b) AS rank FROM pairs",
    "pairs_incremental": f"WITH {pair_rows(0.6)} {PAIRS} WHERE vid_b > (SELECT count(*) // 2 FROM documents)",
    "nearest_benchmark": f"""WITH a AS (WITH {byte_hashes(16, 'benchmark', 'item_id')}, {winnowed(12)} SELECT DISTINCT vid, hash & {BYTES.fp_bits - 1} AS bit FROM chosen), b AS (WITH {BYTE_SOURCE} SELECT DISTINCT vid, hash & {BYTES.fp_bits - 1} AS bit FROM chosen),
        na AS (SELECT vid, count(*) AS n FROM a GROUP BY vid), nb AS (SELECT vid, count(*) AS n FROM b GROUP BY vid), s AS (SELECT a.vid AS q, b.vid, count(*) AS c FROM a JOIN b USING (bit) GROUP BY 1, 2),
        k AS (SELECT q, s.vid, c / (na.n + nb.n - c) AS sim, row_number() OVER (PARTITION BY q ORDER BY c / (na.n + nb.n - c) DESC, s.vid) AS r FROM s JOIN na ON na.vid = q JOIN nb ON nb.vid = s.vid)
        SELECT na.vid AS query, coalesce(k.vid, -1) AS vid, round(coalesce(sim, 0), 6) AS sim FROM na LEFT JOIN k ON k.q = na.vid AND r = 1""",
    "clusters": f"WITH RECURSIVE {cluster_rows()} SELECT cid, vid FROM clusters",
    "recluster_08": f"WITH RECURSIVE {cluster_rows(0.8)} SELECT cid, vid FROM clusters",
    "cluster_sizes": f"WITH RECURSIVE {cluster_rows()} SELECT cid, count(*) AS n, min(vid) AS first_vid FROM clusters GROUP BY cid",
    "size_histogram": f"WITH RECURSIVE {cluster_rows()} SELECT n AS size, count(*) AS clusters FROM (SELECT cid, count(*) AS n FROM clusters GROUP BY cid) GROUP BY n",
    "quality_precision_recall": f"""WITH RECURSIVE {cluster_rows()}, o AS (SELECT cid, lang, count(*) AS n FROM clusters JOIN documents ON doc_id = vid GROUP BY 1, 2)
        SELECT round((SELECT sum(n) FROM (SELECT max(n) AS n FROM o GROUP BY cid)) / (SELECT count(*) FROM clusters), 5) AS precision, round((SELECT sum(n) FROM (SELECT max(n) AS n FROM o GROUP BY lang)) / (SELECT count(*) FROM documents), 5) AS recall""",
    "cdb_text": f"WITH RECURSIVE {cluster_rows()} SELECT cid, cid || ': ' || string_agg(vid::VARCHAR, ' ' ORDER BY vid) || ':' || count(*) || ':' AS value FROM clusters GROUP BY cid",
    "jdb_text": f"WITH {pair_rows(0.6)} SELECT vid_a, vid_b, vid_a || ':' || vid_b || ':' || printf('%.3f', sim) || ':' AS value FROM pairs",
    "cluster_tree": f"""WITH RECURSIVE {cluster_rows()} SELECT cid, '<branch name="' || cid || '">' || string_agg('<leaf name="doc' || vid || '" vlabel="' || source || '"/>', '' ORDER BY vid) || '</branch>' AS xml FROM clusters JOIN documents ON doc_id = vid GROUP BY cid""",
    "cc_init_g": f"WITH {GRID} SELECT rg, cg, n1 FROM ones",
    "cc_row_stats": f"WITH {GRID} SELECT vid, cg, count(*) AS n FROM bits JOIN c USING (bit) GROUP BY 1, 2",
    "cc_row_step": step_sql("vid", "bit", "rg", "cg", "r", "c", "rm", "cm"),
    "cc_col_step": step_sql("bit", "vid", "cg", "rg", "c", "r", "cm", "rm"),
    "cc_cost": f"WITH {GRID}, e AS (SELECT sum({ent('n1', 'rm * cm')}) AS bits, sum(ceil(log2(rm * cm + 1))) AS heads FROM g) SELECT round(2 + 2 + bits + heads + {SIZE_BITS}, 3) AS cost, round(bits * ln(2), 3) AS content_nats FROM e",
    "cc_split_labels": f"WITH {GRID}, top AS (SELECT rg FROM g GROUP BY rg ORDER BY sum({ent('n1', 'rm * cm')}) DESC, rg LIMIT 1), placed AS (SELECT vid, r.rg, m, row_number() OVER (PARTITION BY r.rg ORDER BY vid) AS k FROM r JOIN rs USING (rg)) SELECT vid, (CASE WHEN rg = (SELECT rg FROM top) AND k <= m // 2 THEN {K} ELSE rg END)::INT AS rg FROM placed",
    "cc_merge": f"WITH {GRID} SELECT vid, (CASE WHEN rg < {K - 1} THEN rg WHEN vid < n // 2 THEN {K - 1} ELSE {K} END)::INT AS rg FROM r, total",
    "cc_rowgroup_listing": f"WITH {GRID} SELECT rg, string_agg(source, ' ' ORDER BY vid) AS names FROM r JOIN documents ON doc_id = vid GROUP BY rg",
    "cc_coordinates": f"""WITH {GRID}, y AS (SELECT vid, row_number() OVER (ORDER BY rg, vid) - 1 + rg AS y FROM r), x AS (SELECT bit, row_number() OVER (ORDER BY cg, bit) - 1 + cg AS x FROM c)
        SELECT vid, bit, x, n + {K} - 2 - y AS y FROM bits JOIN y USING (vid) JOIN x USING (bit), total""",
    "cc_dominant": f"WITH {GRID} SELECT vid, CASE WHEN rg = 0 THEN s.n ELSE 0 END AS first_bits, CASE WHEN rg = 0 THEN 0 ELSE s.n END AS other_bits FROM sizes s JOIN r USING (vid)",
    "cc_features": f"WITH {GRID} SELECT cg, pos AS address, lower(hex(hash)) AS shred, bit FROM (SELECT *, hash & 255 AS bit FROM shreds WHERE vid = 7) JOIN c USING (bit)",
    "small_samples": f"""WITH {TURNS}, stat AS ({STATS.format(mask=Params().fp_bits - 1, rows="chosen")})
        SELECT vid, nshred, nhash, nbits, CASE WHEN nbits IS NULL THEN 'too_small' ELSE 'accepted' END AS status FROM (SELECT conv_id * 1000 + turn AS vid FROM conversations) LEFT JOIN stat USING (vid)""",
    "multi_hash_stats": f"""WITH hashed AS (SELECT * FROM (WITH {line_hashes()} SELECT vid, hash FROM shreds) UNION ALL SELECT * FROM (WITH {line_hashes('sdbm')} SELECT vid, hash FROM shreds))
        SELECT vid, count(*) // 2 AS nshred, count(*) // 2 AS nhash, count(DISTINCT hash & {TEXT.fp_bits - 1}) AS nbits FROM hashed GROUP BY vid""",
    "pe_fingerprint_stats": f"WITH {BYTE_SOURCE} " + STATS.format(mask=BYTES.fp_bits - 1, rows="chosen"),
    "pe_both_sections": f"WITH {both_cases(4)} SELECT vid // 2 AS vid, count(*) AS nshred, count(*) AS nhash, count(DISTINCT hash & {Params().fp_bits - 1}) AS nbits FROM shreds GROUP BY vid // 2",
    "pe_pairs": f"WITH {pair_rows(0.7, bits=bit_rows(BYTES, byte_hashes(16, "(SELECT doc_id, translate(text, 'aeiou', 'AEIOU') AS text FROM documents)") + ', ' + winnowed(12)))} {PAIRS}",
    "point_read": f"WITH {bit_rows()} SELECT vid, any_value(nshred) AS nshred, count(*) AS nbits, string_agg(bit::VARCHAR, ',' ORDER BY bit) AS bits FROM bits JOIN (SELECT vid, count(*) AS nshred FROM shreds GROUP BY vid) USING (vid) WHERE vid IN (7, 11) GROUP BY vid",
    "short_names": "SELECT page_id, string_split(url, '/')[-1][1:32] AS name FROM pages",
    "name_search": "SELECT doc_id AS vid, 'doc' || doc_id AS name, source AS vlabel FROM documents WHERE 'doc' || doc_id LIKE '%c1%' OR source LIKE '%c1%'",
    "cdb_single": f"WITH RECURSIVE {cluster_rows()} SELECT cid, 'C' || cid || ': ' || string_agg(vid::VARCHAR, ' ' ORDER BY vid) AS value FROM clusters GROUP BY cid",
    "cdb_openmp": f"WITH RECURSIVE {cluster_rows()} SELECT cid, cid || ':' || string_agg(vid::VARCHAR, ' ' ORDER BY vid) || ' :' || count(*) || ':' AS value FROM clusters GROUP BY cid",
    "jdb_steps": f"WITH {pair_rows(0.6)} SELECT vid_a, vid_b, vid_a || ':' || vid_b || ':' || printf('%.6f', sim) || ':' AS value FROM pairs",
    "jdb_hadoop": f"WITH {pair_rows(0.6)} SELECT vid_a, vid_b, rtrim(rtrim(printf('%.6f', sim), '0'), '.') || chr(9) || ':' || vid_a || ':' || vid_b || ':' AS value FROM pairs",
    "cc_permute": f"""WITH {GRID}, dens AS (SELECT rg, cg, rm * cm AS area, n1::FLOAT / (rm * cm)::FLOAT AS dn FROM g), top AS (SELECT rg FROM dens GROUP BY rg ORDER BY sum(CASE WHEN dn > 0.95::FLOAT THEN area ELSE 0 END) DESC, rg LIMIT 1),
        cols AS (SELECT cg, any_value(dn) FILTER (rg = (SELECT rg FROM top)) AS f, sum(dn) AS total FROM dens GROUP BY cg), ranked AS (SELECT cg, (row_number() OVER (ORDER BY (f = 0), CASE WHEN f > 0 THEN f ELSE total END DESC, cg) - 1)::INT AS new FROM cols)
        SELECT bit::INT AS bit, new AS cg FROM c JOIN ranked USING (cg)""",
    "cc_split_columns": f"""WITH {GRID}, top AS (SELECT cg, row_number() OVER (ORDER BY sum({ent('n1', 'rm * cm')}) DESC, cg) - 1 AS i FROM g GROUP BY cg), placed AS (SELECT bit, c.cg, m, row_number() OVER (PARTITION BY c.cg ORDER BY bit) AS k FROM c JOIN cs USING (cg))
        SELECT bit::INT AS bit, (CASE WHEN i < 2 AND k <= m // 2 THEN {L} + i ELSE cg END)::INT AS cg FROM placed JOIN top USING (cg)""",
    "cc_merge_columns": f"WITH {GRID} SELECT bit::INT AS bit, (dense_rank() OVER (ORDER BY cg, bit % 3) - 1)::INT AS cg FROM c",
    "cc_merge_bits": f"WITH {GRID} SELECT vid, bit::INT AS bit FROM bits",
    "cc_dump_r": f"WITH {GRID} SELECT string_agg(rg::VARCHAR, ',' ORDER BY vid) AS value FROM r",
    "cc_dump_c": f"WITH {GRID} SELECT string_agg(cg::VARCHAR, ',' ORDER BY bit) AS value FROM c",
    "cc_dump_g": f"WITH {GRID} SELECT rg::INT AS rg, string_agg(n1::VARCHAR, ',' ORDER BY cg) AS value FROM g GROUP BY rg",
}
