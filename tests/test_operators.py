import itertools
import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from simloom.operators import clustering as cl
from simloom.operators import cocluster as cc
from simloom.operators import fingerprint as fp
from simloom.operators import similarity as sim
from simloom.params import Params
from simloom.sources import readers, writers
from simloom.streaming.incremental import start


def prints(spark, sets):
    return spark.createDataFrame([(i, sorted(s), len(s)) for i, s in enumerate(sets)], "vid long, bits array<int>, nbits long")


@pytest.mark.parametrize("measure", ["jaccard", "containment", "harmony"])
def test_join_equals_brute_force(spark, measure):
    rng = random.Random(4)
    base = [set(rng.sample(range(60), rng.randint(1, 20))) for _ in range(25)]
    sets = base + [set(rng.sample(sorted(b), max(1, len(b) - 1))) for b in base] + base[:5]
    want = {}
    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        jac, con = len(a & b) / len(a | b), len(a & b) / min(len(a), len(b))
        s = {"jaccard": jac, "containment": con, "harmony": jac if len(a) == len(b) else con}[measure]
        if s >= 0.6:
            want[i, j] = round(s, 9)
    got = {(r.vid_a, r.vid_b): round(r.sim, 9) for r in sim.similarity_join(prints(spark, sets), 0.6, measure).collect()}
    assert got == want
    if measure == "jaccard":
        new = {(r.vid_a, r.vid_b) for r in sim.incremental_join(prints(spark, sets), 20, 0.6).collect()}
        assert new == {p for p in want if p[1] > 20}
        assert sim.all_pairs(prints(spark, sets[:9])).count() == 36


def test_float_edges(spark):
    sets = [set(range(10)), set(range(7))]
    assert sim.similarity_join(prints(spark, sets), 0.7, numeric="exact").count() == 1
    assert sim.similarity_join(prints(spark, sets), 0.7, numeric="float32").count() == 0


def test_nearest_keeps_misses_and_lowest(spark):
    db = prints(spark, [{1, 2}, {1, 2}, {9}])
    got = {r["query"]: (r.vid, r.sim) for r in sim.nearest(prints(spark, [{1, 2}, {50}]), db).collect()}
    assert got == {0: (0, 1.0), 1: (-1, 0.0)}


def test_clusters_and_quality(spark):
    vids = spark.range(7).withColumnRenamed("id", "vid")
    pairs = spark.createDataFrame([(0, 3, 0.9), (3, 5, 0.7), (1, 2, 0.65)], "vid_a long, vid_b long, sim double")
    got = {r.vid: r.cid for r in cl.cluster(vids, pairs, 0.6).collect()}
    assert got == {0: 0, 3: 0, 5: 0, 1: 1, 2: 1, 4: 2, 6: 3}
    assert {r.vid: r.cid for r in cl.cluster(vids, pairs, 0.8).collect()}[5] != 0
    c = cl.cluster(vids, pairs, 0.6)
    assert tuple(cl.quality(c, c).first()) == (1.0, 1.0)
    for style in ("single", "steps", "openmp"):
        assert sorted(map(tuple, writers.parse_clusters(writers.cluster_lines(c, style)).collect())) == sorted((x, v) for v, x in got.items())
    assert writers.parse_pairs(writers.pair_lines(pairs)).count() == 3
    r = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "cid int, vid long")
    q = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "cid int, vid long")
    assert tuple(cl.quality(r, q).first()) == (0.66667, 1.0)


def test_fingerprints(spark):
    own = spark.createDataFrame([(0, "a\nb\n"), (1, None), (2, ""), (3, "a\nb\n")], "vid long, data string")
    params = Params(shred_size=1, fp_bits=256, max_set_ratio=None)
    got = fp.fingerprints(own, params)
    rows = {r.vid: r.bits for r in got.collect()}
    assert set(rows) == {0, 3} and rows[0] == rows[3]
    assert {r.vid: r.status for r in fp.catalogue(own, got, params).collect()} == {0: "accepted", 1: "too_small", 2: "too_small", 3: "accepted"}
    back = fp.from_dense(fp.dense(got, params), params, "vid", "fp")
    assert {r.vid: r.bits for r in back.collect()} == rows
    assert [r.vid for r in fp.with_vids(own.select("data", own.vid.alias("k")), "k", 1).orderBy("vid").collect()] == [1, 2, 3, 4]


def test_planted_blocks(spark):
    rows = [(v, b) for v in range(8) for b in range(16) if (v < 4) == (b < 8)]
    post = spark.createDataFrame(rows, "vid long, bit int")
    vids = spark.range(8).withColumnRenamed("id", "vid")
    s = cc.initial(spark, vids, 16, 2, 2, None)
    out, _ = cc.refine(post, s)
    assert (out.k, out.l) == (2, 2)
    assert cc.cost_of(post, out, "content") == 0
    assert cc.matrix(cc.block_counts(post, out.r, out.c), 2, 2).sum() == len(rows)
    halves = cc.split(post, out, "row", 1)
    assert halves.k == 3 and halves.r.where("rg = 2").count() == 2
    a = cc.State(spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "vid long, rg int"), s.c, 2, 2)
    b = cc.State(spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "vid long, rg int"), s.c, 2, 2)
    merged = cc.merge(a, b, post, post)[1]
    assert [r.rg for r in merged.r.orderBy("vid").collect()] == [0, 1, 2] and merged.k == 3


def test_sources(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.bin").write_bytes(b"hello")
    (tmp_path / "in/deep/b.bin").write_bytes(b"MZ")
    files = readers.sample_files(spark, str(tmp_path / "in"))
    assert files.count() == 2 and readers.sample_files(spark, str(tmp_path / "in"), 1).count() == 1
    assert readers.executable_samples(files).where("size(data) > 0").count() == 0
    (tmp_path / "log").write_text("x/y:virus:packer:\n\nz:w::\n")
    assert sorted(map(tuple, readers.labelled_log(spark, str(tmp_path / "log")).collect())) == [("x/y", "virus", "packer"), ("z", "w", "")]


def test_stream_equals_batch(spark, tmp_path):
    lines = ["a\nb\nc\nd\n", "a\nb\nc\ne\n", "x\ny\n", "a\nb\nc\nd\n", "x\ny\nz\n"]
    for i, x in enumerate(lines):
        spark.createDataFrame([(i, x)], "vid long, data string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    params = Params(shred_size=1, threshold=0.5)
    whole = sim.similarity_join(fp.fingerprints(spark.read.parquet(str(tmp_path / "in")), params), 0.5)
    stream = spark.readStream.schema("vid long, data string").parquet(str(tmp_path / "in"))
    start(stream, str(tmp_path / "store"), str(tmp_path / "pairs"), str(tmp_path / "check"), params).awaitTermination()
    got = {(r.vid_a, r.vid_b) for r in spark.read.parquet(str(tmp_path / "pairs")).collect()}
    assert got == {(r.vid_a, r.vid_b) for r in whole.collect()} and len(got) == 4


def test_copies_and_shared_bits(spark):
    """Many copies, and a bit that all share: links and clusters need no row for each pair."""
    rng = random.Random(2)
    base = sorted({0, *rng.sample(range(1, 5000), 30)})
    sets = [base] * 10_000 + [sorted({0, *rng.sample(range(1, 5000), 30)}) for _ in range(2000)] + [base[:-1]]
    fps = prints(spark, sets)
    links = sim.similarity_links(fps, 0.8)
    assert links.count() == 10_000
    got = {r.vid: r.cid for r in cl.similarity_clusters(fps, 0.8).collect()}
    assert all(got[i] == 0 for i in [*range(10_000), 12_000]) and len(set(got.values())) == 2001
    assert sim.incremental_join(fps, 11_999, 0.8).count() == 10_000
    near = sim.nearest(prints(spark, [base[:-1], [0]]), fps).collect()
    assert {(r["query"], r.vid, round(r.sim, 6)) for r in near} == {(0, 12_000, 1.0), (1, 12_000, round(1 / 30, 6))}


@pytest.mark.parametrize("measure", ["jaccard", "containment", "harmony"])
def test_incremental_and_nearest_equal_brute_force(spark, measure):
    rng = random.Random(6)
    base = [set(rng.sample(range(50), rng.randint(1, 15))) for _ in range(20)]
    sets = base + base[:6] + [set(rng.sample(sorted(b), max(1, len(b) - 1))) for b in base] + [set()]
    fps = prints(spark, sets)
    for through in (-1, 10, 22, 100):
        got = {(r.vid_a, r.vid_b) for r in sim.incremental_join(fps, through, 0.6, measure).collect()}
        assert got == {(r.vid_a, r.vid_b) for r in sim.similarity_join(fps, 0.6, measure).collect() if r.vid_b > through}
    if measure == "jaccard":
        asked = [set(rng.sample(range(60), rng.randint(0, 12))) for _ in range(15)] + base[:2] + [{900}]
        got = {r["query"]: (r.vid, round(r.sim, 9)) for r in sim.nearest(prints(spark, asked), fps).collect()}
        for q, a in enumerate(asked):
            sims = [len(a & b) / len(a | b) if a | b else 0 for b in sets]
            best = max(sims)
            assert got[q] == ((sims.index(best), round(best, 9)) if best else (-1, 0.0))


def test_long_chains_are_one_component(spark):
    n = 600
    order = list(range(n))
    random.Random(1).shuffle(order)
    pairs = spark.createDataFrame([(min(a, b), max(a, b), 1.0) for a, b in itertools.pairwise(order)], "vid_a long, vid_b long, sim double")
    got = cl.connected(spark.range(n + 2).withColumnRenamed("id", "vid"), pairs).collect()
    assert {r.vid: r.root for r in got} == {i: 0 for i in range(n)} | {n: n, n + 1: n + 1}


def plain_change(m, r, c, k, l, axis):
    """Labels after a pass against frozen blocks, cell by cell: lowest tie and the tie that stays."""
    x, own, other, a, b = (m, r, c, k, l) if axis == 0 else (m.T, c, r, l, k)
    g = np.array([[x[np.ix_(own == i, other == j)].sum() for j in range(b)] for i in range(a)], float)
    rows, cols = np.array([(own == i).sum() for i in range(a)]), np.array([(other == j).sum() for j in range(b)])

    def bits(ones, area):
        return ones * math.log2(area / ones) + (area - ones) * math.log2(area / (area - ones)) if 0 < ones < area else 0.0

    def line(i, extra, size):
        return sum(bits(g[i, j] + extra[j], size * cols[j]) for j in range(b))

    out = []
    for item, mine in enumerate(own):
        stat = np.array([x[item, other == j].sum() for j in range(b)])
        left = line(mine, -stat, rows[mine] - 1) - line(mine, 0 * stat, rows[mine])
        cost = [0.0 if i == mine else round(left + line(i, stat, rows[i] + 1) - line(i, 0 * stat, rows[i]), 6) for i in range(a)]
        out.append((cost.index(min(cost)), cost.index(min(cost)) if min(cost) < 0 else mine))
    return out


def plain_refine(m, r, c, ties, factor, kind):
    def dense(labels):
        used = sorted(set(labels.tolist()))
        return np.array([used.index(x) for x in labels]), len(used)

    before, k, l = math.inf, r.max() + 1, c.max() + 1  # noqa: E741
    while True:
        r, k = dense(np.array([x[ties == "current"] for x in plain_change(m, r, c, k, l, 0)]))
        c, l = dense(np.array([x[ties == "current"] for x in plain_change(m, r, c, k, l, 1)]))  # noqa: E741
        g = np.array([[m[np.ix_(r == i, c == j)].sum() for j in range(l)] for i in range(k)])
        sizes = [np.bincount(x) for x in (r, c)]
        cost = cc.description_cost(g, *sizes) if kind == "description" else cc.content_cost(g, *sizes, math.e)
        if cost >= before * factor:
            return r, c, cost, min(before, cost)
        before = cost


@pytest.mark.parametrize("ties, factor, kind", [("lowest", 1.0, "description"), ("current", 0.999, "content")])
def test_refine_equals_plain_loops(spark, ties, factor, kind):
    rng = np.random.default_rng(4)
    m = (rng.random((12, 16)) < np.kron(rng.random((3, 4)), np.ones((4, 4)))).astype(int)
    m[:, 5] = m[:, 11] = 0
    post = spark.createDataFrame([(int(v), int(b)) for v, b in zip(*np.nonzero(m))], "vid long, bit int")
    start = cc.initial(spark, spark.range(12).withColumnRenamed("id", "vid"), 16, 3, 4, None)
    got, low = cc.refine(post, start, factor, ties, kind)
    r, c, cost, least = plain_refine(m, np.arange(12) // 4, np.arange(16) // 4, ties, factor, kind)
    assert [x.rg for x in got.r.orderBy("vid").collect()] == r.tolist()
    assert [x.cg for x in got.c.orderBy("bit").collect()] == c.tolist()
    assert abs(got.cost - cost) < 1e-6 and abs(low - least) < 1e-6


def test_searches(spark):
    m = np.kron(np.array([[1, 0, 1], [0, 1, 1], [1, 1, 0]]), np.ones((4, 6), int))
    fps = spark.createDataFrame([(10 + i, np.flatnonzero(row).tolist()) for i, row in enumerate(m)], "vid long, bits array<int>")
    for how in ("split", "grid"):
        ids, post, s = cc.cocluster(fps, 18, 1, 1, seed=5, how=how)
        assert sorted(r.vid for r in ids.collect()) == list(range(12)) and post.count() == m.sum()
        r, c = (np.array([x[1] for x in f.orderBy(f.columns[0]).collect()]) for f in (s.r, s.c))
        g = np.array([[m[np.ix_(r == i, c == j)].sum() for j in range(s.l)] for i in range(s.k)])
        want = cc.description_cost(g, np.bincount(r), np.bincount(c)) if how == "split" else cc.content_cost(g, np.bincount(r), np.bincount(c), math.e)
        assert how == "grid" or abs(s.cost - want) < 1e-6
        if how == "split":  # no worse than it began
            assert s.cost <= cc.description_cost(np.array([[m.sum()]]), np.array([12]), np.array([18]))
    with pytest.raises(ValueError):
        cc.initial(spark, spark.range(3).withColumnRenamed("id", "vid"), 16, 0, 2)


def test_random_cuts():
    for n, groups in ((100, 4), (7, 3), (64, 64)):
        seen = [cc.random_cuts(n, groups, seed) for seed in range(80)]
        stripe = n // groups
        assert all(len(x) == groups - 1 and all(i * stripe <= c < (i + 1) * stripe for i, c in enumerate(x)) for x in seen)
        if stripe > 1:
            assert {2 * (c - i * stripe) < stripe for x in seen for i, c in enumerate(x)} == {True, False}
    assert cc.random_cuts(100, 4, 7) == cc.random_cuts(100, 4, 7)


def test_dumps_and_merge(spark):
    r = spark.createDataFrame([(2, 1), (0, 0), (1, 1)], "vid long, rg int")
    assert writers.label_line(r, "vid", "rg").first()[0] == "0,1,1"
    blocks = spark.createDataFrame([(0, 1, 5), (2, 0, 7)], "rg int, cg int, n1 long")
    assert [x.value for x in writers.block_lines(blocks, 3, 2).orderBy("rg").collect()] == ["0,5", "0,0", "7,0"]


def test_numbered_files_and_matrix_folders(spark, tmp_path):
    params = Params(fp_bits=16, max_set_ratio=None)
    for name, rows in (("b", [[1, 9]]), ("a", [[0], [], [15, 3]])):
        (tmp_path / name).write_bytes(b"".join(sum(1 << x for x in row).to_bytes(2, "little") for row in rows))
    got = readers.matrix_folder(spark, str(tmp_path), params).orderBy("vid").collect()
    assert [(r.vid, r.nbits, r.bits) for r in got] == [(0, 1, [0]), (1, 0, []), (2, 2, [3, 15]), (3, 2, [1, 9])]
    assert sorted(r.vid for r in readers.matrix_folder(spark, str(tmp_path), params, 2).collect()) == [0, 1]
    files = readers.sample_files(spark, str(tmp_path), numbered=True).orderBy("vid").collect()
    assert [r.path[-1] for r in files] == ["a", "b"] and [r.path[-1] for r in readers.sample_files(spark, str(tmp_path), 1).collect()] == ["a"]


def test_stream_refuses_ids_that_do_not_grow(spark, tmp_path):
    from simloom.streaming.incremental import batch_writer

    write = batch_writer(str(tmp_path / "store"), str(tmp_path / "pairs"), Params(shred_size=1))
    rows = lambda *ids: spark.createDataFrame([(i, f"a\n{i}\n") for i in ids], "vid long, data string")
    write(rows(5, 6), 0)
    write(rows(7), 1)
    write(rows(7), 1)
    with pytest.raises(ValueError):
        write(rows(6, 9), 2)


def test_scratch_tables_go(spark, tmp_path):
    from simloom.common import scratch, settled

    with scratch(spark):
        kept = settled(spark.range(3))
        path = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:")
        import os

        assert kept.count() == 3 and os.path.isdir(path)
    assert not os.path.exists(path)


def test_sets_that_meet_by_chance_are_not_verified(spark, monkeypatch):
    """Long sets over few bits: each shares rare bits with most others, and none is similar."""
    rng = random.Random(9)
    sets = [set(rng.sample(range(4000), rng.randint(60, 120))) for _ in range(800)]
    near = [set(s) - set(rng.sample(sorted(s), 5)) | {4001} for s in sets[:20]]
    seen = []
    verified = sim.verified
    monkeypatch.setattr(sim, "verified", lambda pairs, *rest: (seen.append(pairs.count()), verified(pairs, *rest))[1])
    got = {(r.vid_a, r.vid_b) for r in sim.similarity_join(prints(spark, sets + near), 0.7).collect()}
    assert got == {(i, 800 + i) for i in range(20)}
    assert seen[0] < 200


@pytest.mark.parametrize("measure", ["containment", "jaccard"])
def test_frequent_bits_are_dealt_in_slices(spark, monkeypatch, measure):
    """A bit that all sets have makes more joined rows than a task is to get."""
    monkeypatch.setattr(sim, "TASK_ROWS", 500)
    asked = []
    monkeypatch.setattr(sim, "partitions", lambda spark, least: (asked.append(least), 7)[1])
    sets = [{0, i} for i in range(1, 61)] + [{0}]
    got = {(r.vid_a, r.vid_b): r.inter for r in sim.similarity_join(prints(spark, sets), 0.3, measure).collect()}
    assert got == {(i, j): 1 for i, j in itertools.combinations(range(61), 2)}
    assert max(asked) > 7


def test_ids_of_many_partitions_need_no_window(spark):
    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("k"))
    got = fp.with_vids(rows, "k", 1, "rank", 23)
    assert sorted((r["rank"], r.k) for r in got.collect()) == [(i + 1, i) for i in range(500)]
    assert "Window" not in got._jdf.queryExecution().toString()


def test_long_and_short_samples_are_cut_in_pieces_of_bytes():
    import pyarrow as pa

    from simloom.common import pieces

    texts = [b"x" * n for n in (10, 900, 5, 0, 3000, 40, 41, 900, 99)]
    for column in (pa.array(texts), pa.array([[t, t[:1]] for t in texts])):
        batch = pa.RecordBatch.from_arrays([pa.array(range(9)), column], ["vid", "data"])
        got = list(pieces([batch, batch.slice(0, 0)], 1, 1200))
        assert [x for p in got for x in p.column(1).to_pylist()] == column.to_pylist()
        assert all(p.num_rows == 1 or p.column(1).nbytes <= 1200 for p in got) and len(got) < 9


def test_tables_of_samples_are_not_broadcast(spark):
    s = cc.initial(spark, spark.range(50).withColumnRenamed("id", "vid"), 16, 2, 2, None)
    post = spark.range(200).select((F.col("id") % 50).alias("vid"), (F.col("id") * 7 % 16).cast("int").alias("bit"))
    for df in (cc.block_counts(post, s.r, s.c), cc.line_statistics(post, s.r, "bit", "vid", "rg")):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin [vid" in plan and "BroadcastHashJoin [vid" not in plan
    assert sum(x.n1 for x in cc.block_counts(post, s.r, s.c).collect()) == 200


def test_few_queries_read_the_samples_once(spark, monkeypatch):
    """Samples that bits of few queries are looked for in are neither written nor shuffled, and both ways find the same."""
    rng = random.Random(12)
    sets = [set(rng.sample(range(300), rng.randint(0, 40))) for _ in range(300)]
    sets += sets[:40] + [{0, i} for i in range(1, 50)]
    asked = [set(rng.sample(range(400), rng.randint(0, 30))) for _ in range(40)] + sets[5:15] + [{0}, {999}]
    fps, queries = prints(spark, sets), prints(spark, asked)
    far = {r["query"]: (r.vid, round(r.sim, 9)) for r in sim.nearest(queries, fps, broadcast_rows=0).collect()}
    monkeypatch.setattr(sim, "PART_BITS", 50)
    monkeypatch.setattr(sim, "equal_classes", None)
    got = sim.nearest(queries, fps)
    assert {r["query"]: (r.vid, round(r.sim, 9)) for r in got.collect()} == far
    assert len(far) == len(asked) and far[51] == (-1, 0.0)


@pytest.mark.parametrize("through", [None, 90])
def test_similar_groups_of_long_sets_in_small_cells(spark, monkeypatch, through):
    """Keys of many classes are dealt in slices, and groups of similar classes are verified in several cells."""
    rng = random.Random(14)
    base = [set(rng.sample(range(5000), n)) for n in (36, 70, 150)]
    sets = [set(rng.sample(sorted(b), int(len(b) * rng.uniform(0.8, 1)))) | {rng.randrange(5000)} for b in base for _ in range(35)]
    rng.shuffle(sets)
    for name, value in (("TASK_ROWS", 300), ("DEALT", 1), ("CELL_BITS", 500), ("CELL_ROWS", 9), ("PAIR_ROWS", 100)):
        monkeypatch.setattr(sim, name, value)
    pairs = sim.similarity_join(prints(spark, sets), 0.7) if through is None else sim.incremental_join(prints(spark, sets), through, 0.7)
    got = {(r.vid_a, r.vid_b): (r.inter, r.uni) for r in pairs.collect()}
    want = {(i, j): (len(a & b), len(a | b)) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if 10 * len(a & b) >= 7 * len(a | b)}
    assert got == {k: v for k, v in want.items() if through is None or k[1] > through} and len(want) > 500


def test_keys_of_long_sets_are_no_rows(spark, monkeypatch):
    """Two bits that only one set has in its prefix are neither written nor shuffled as a row, and pairs carry no bits."""
    rng = random.Random(15)
    sets = [set(rng.sample(range(1 << 18), 300)) for _ in range(150)]
    sets += [s - set(rng.sample(sorted(s), 9)) for s in sets[:50]]
    written, settled = [], sim.settled
    monkeypatch.setattr(sim, "settled", lambda df, **rest: (written.append(settled(df, **rest)), written[-1])[1])
    assert sim.similarity_join(prints(spark, sets), 0.7).count() == 50
    spark.catalog.clearCache()
    rows = [x.count() for x in written if "bits" not in x.columns and "h" not in x.columns]
    assert max(rows) < 8000, rows
    assert not [x.columns for x in written if "bits_a" in x.columns or "bits" in x.columns and "a" in x.columns]


@pytest.mark.parametrize("measure", ["containment", "harmony"])
def test_tasks_follow_the_rows_of_all_keys(spark, monkeypatch, measure):
    """No bit makes more joined rows than a task is to get, but all together do; classes are compared with few and with many partners at once."""
    monkeypatch.setattr(sim, "TASK_ROWS", 500)
    monkeypatch.setattr(sim, "RUN_BITS", 40)
    monkeypatch.setattr(sim, "CARRIED", 0 if measure == "harmony" else 64)
    asked = []
    monkeypatch.setattr(sim, "partitions", lambda spark, least: (asked.append(least), 7)[1])
    rng = random.Random(16)
    sets = [set(rng.sample(range(60 * g, 60 * g + 12), rng.randint(2, 9))) for g in range(40) for _ in range(9)]
    got = {(r.vid_a, r.vid_b): r.inter for r in sim.similarity_join(prints(spark, sets), 0.6, measure).collect()}
    want = {}
    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        s = len(a & b) / (len(a | b) if measure == "harmony" and len(a) == len(b) else min(len(a), len(b)))
        if s >= 0.6:
            want[i, j] = len(a & b)
    assert got == want
    assert max(asked) > 7
