"""Classifiers, the pipeline's stages and odd inputs against plain loops."""

import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from simloom.llm import audio, chat, decontaminate, html_text, language_id, ngram_join, packing, quality, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, stats string, label int, rep string"
AL = "the of and a thou shalt not never ever more quick brown fox jumps over lazy dog".split()
UMLAUT = "der die das und nicht über schön größe mit auf für ein wir".split()


def docs_of(spark, rows):
    """rows: (doc_id, text, lang). With extra columns whose names clash with those used within."""
    return spark.createDataFrame([(i, t, lang, "s", None, "x", "y", 5, None) for i, t, lang in rows], SCHEMA)


def prose(rng, n, words=AL):
    return " ".join(rng.choice(words) + rng.choice("abcdefgh") for _ in range(n))


def folds(i, k):
    return zlib.crc32(str(i).encode()) % k


def plain_quality(docs, labels):
    """Scores by textbook formulas, without sums of moments or Cholesky factors."""
    member = quality.char_classes()
    x = {i: np.array(quality.statistics(t, member)) for i, t, *_ in docs if i is not None}
    own = {k: np.array([x[i] for i, q in labels if i is not None and q == k and i in x and folds(i, 5)]) for k in (0, 1)}
    mean, cov = {k: v.mean(0) for k, v in own.items()}, {k: np.cov(v.T, bias=True) for k, v in own.items()}
    n = {k: len(v) for k, v in own.items()}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    out, shrunk = [], {}
    for k in (0, 1):
        c = (0.9 * cov[k] + 0.1 * pooled) / np.outer(scale, scale)
        shrunk[k] = 0.98 * c + 0.02 * max(np.trace(c) / len(c), 1e-3) * np.eye(len(c))
    for i, t, *_ in docs:
        z = np.array(quality.statistics(t, member))
        density = {}
        for k in (0, 1):
            d = (z - mean[k]) / scale
            density[k] = -0.5 * d @ np.linalg.solve(shrunk[k], d) - 0.5 * np.linalg.slogdet(shrunk[k])[1] + np.log(n[k] / (n[0] + n[1]))
        out.append(1 / (1 + np.exp(-np.clip((density[1] - density[0]) / 4, -700, 700))))
    return out


@pytest.fixture(scope="module")
def marked():
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(20, 80)) + ("." if i % 2 else "!! || 99"), "en") for i in range(60)]
    labels = [(i, i % 2) for i in range(60)] + [(None, 1), (7, None), (3, 1), (500, 0)]
    return rows + [(100, None, None), (101, "", "en"), (102, "", "en"), (3, rows[3][1], "en"), (None, "of", None), (103, prose(rng, 9000), "en")], labels


def test_op3_equals_plain_formulas(spark, marked):
    rows, labels = marked
    table = spark.createDataFrame([(i, q, "clash") for i, q in labels], "doc_id long, quality int, stats string")
    unique = [r for r in rows if r[0] != 3] + [r for r in rows if r[0] == 3][:1]
    got = quality.score_quality(docs_of(spark, unique).repartition(5), table).collect()
    want = plain_quality(unique, labels)
    for (i, *_), w in zip(unique, want):
        (r,) = (r for r in got if r.doc_id == i)
        assert abs(r.score - w) < 1e-6 and r.predicted == int(w >= 0.3) and r.held_out == (None if i is None else folds(i, 5) == 0)
    twice = quality.score_quality(docs_of(spark, rows), table).where("doc_id = 3 or doc_id in (101, 102)").collect()
    assert len(twice) == 4 and len({r.score for r in twice if r.doc_id == 3}) == len({r.score for r in twice if r.doc_id != 3}) == 1


def plain_toxicity(text, slopes):
    mask, found = (1 << 64) - 1, []
    words = list(dict.fromkeys(re.findall(rb"[a-z0-9@\x80-\xff]+", (text or "").lower().encode())))

    def bucket(h):
        return ((h ^ h >> 29) >> 7) & (toxicity.BUCKETS - 1)

    for word in words:
        values = []
        for a in range(0, len(word), toxicity.LONGEST):
            c = b"<" + word[a : a + toxicity.LONGEST] + b">"
            power = [pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(len(c))]
            for n in toxicity.NGRAMS:
                for i in range(len(c) - n + 1):
                    values.append(bucket((sum(c[i + j] * power[j] for j in range(n)) * 0xC2B2AE3D27D4EB4F + n) & mask))
            values.append(bucket(sum(x * p for x, p in zip(c, power)) * 0xD6E8FEB86659FD93 & mask))
        values = [slopes[0][v] for v in values if not np.isnan(slopes[0][v])]
        found.append(sum(map(float, values)) / len(values) if values else 0.0)
    clean = 1.0
    for a in range(0, len(found), toxicity.WINDOW):
        part = found[a : a + toxicity.WINDOW]
        clean /= 1 + np.exp(sum(part) / len(part) + slopes[1])
    return 1 - clean


def test_op9_scores_equal_plain_loop(spark):
    rng = np.random.default_rng(2)
    slopes = np.where(rng.random(toxicity.BUCKETS) < 0.5, np.nan, rng.normal(0, 3, toxicity.BUCKETS)).astype(np.float32), -1.5
    texts = ["You Idiot", "über größe idiot, idiot", "a", "x" * 100 + " @@ 99", None, "", "!!! ...", prose(random.Random(1), 50)]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs_of(spark, [(i, t, None) for i, t in enumerate(texts)]), slopes).collect()}
    assert all(abs(got[i] - plain_toxicity(t, slopes)) < 1e-5 for i, t in enumerate(texts)) and got[4] == got[5] == got[6] == 0


def test_stages_give_back_heap_first(monkeypatch):
    import corpus_pipeline

    class Asked(Exception):
        pass

    def ask(spark):
        raise Asked

    monkeypatch.setattr(corpus_pipeline, "give_back", ask)
    for name, stage in corpus_pipeline.STAGES:
        with pytest.raises(Asked):
            stage(None, None, "")
            pytest.fail(name)


def test_op4_blocks_in_bounded_memory():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 400 + 40_000 * (i % 3), 600).astype(np.int32)) for i in range(200)]
    one, two = np.arange(0, 120), np.arange(90, 200)
    tracemalloc.start()
    shared = ngram_join.shared_counts(sets, one, two)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.array([[len(np.intersect1d(sets[i], sets[j])) for j in two] for i in one])
    others = one[:, None] != two
    assert np.array_equal(shared[others], want[others]) and shared[others].max() > 200
    assert peak < 40 * sum(map(len, sets)) + 4 * 1024 * 2.2 * len(sets) + 8 * shared.size
    assert ngram_join.shared_counts([np.array([1], np.int32), np.array([2], np.int32)], np.array([0]), np.array([1])).tolist() == [[0]]


def test_op9_gradients():
    net = toxicity.SubwordSoftmax()
    docs = net.prepared([b"bad words here", b"good words here now", b"bad bad day", b"words now"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    y, cost = np.array([1, 0, 1, 0]), np.array([2.0, 1.0, 2.0, 1.0])
    g = net.gradients(docs, y, cost)
    assert len(net.learned)
    for name, at in (("e", (0, 0)), ("e", (len(net.learned) - 1, 2)), ("w", (1, 0)), ("w", (3, 1)), ("b", (1,))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-4
        up = net.loss(docs, y, cost)
        net.p[name][at] = old - 1e-4
        down = net.loss(docs, y, cost)
        net.p[name][at] = old
        assert abs((up - down) / 2e-4 - g[name][at]) < 1e-4 * max(1, abs(g[name][at]))


def test_op9_odd_samples_and_misspellings(spark):
    rng = random.Random(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    wordless = docs_of(spark, [(i, "!!! ...", None) for i in range(20)])
    assert toxicity.fit_toxicity(wordless, labels) is None
    rows = [(i, prose(rng, 30) + (" worthless " if i % 2 else " pleasant ") + prose(rng, 30), None) for i in range(300)]
    slopes = toxicity.fit_toxicity(docs_of(spark, rows), labels)
    probe = [prose(rng, 40) + " w0rthless", prose(rng, 40) + " worthlesss", prose(rng, 40) + " pleasantly", prose(rng, 400)]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs_of(spark, [(i, t, None) for i, t in enumerate(probe)]), slopes).collect()}
    assert got[0] > 0.5 and got[1] > 0.5 and got[2] < 0.5 and got[3] < 0.5


def test_op8_long_and_repeated_pages(spark):
    rng = random.Random(6)
    notice = "all of this is kept by us for you and for them"
    long = "</p><p>".join(prose(rng, 40) for _ in range(6000))
    pages = [(i, "http://h/", f"<body><p>{notice}</p><p>{prose(rng, 30)}</p></body>") for i in range(12)] + [(50, "http://h/", f"<body><p>{notice}</p><p>{long}</p></body>")] + [(60, "http://r/", "<p>one two three four five</p>")] * 7
    got = {}
    for r in html_text.extract_text(spark.createDataFrame([(*p, "a", 1, "b") for p in pages], "page_id long, url string, html string, blocks string, shard int, host string")).collect():
        got.setdefault(r.page_id, []).append((r.text, r.n_chars))
    assert got[50] == [(long.replace("</p><p>", "\n"), len(long) - 6 * 5999)]
    big = [(2**60 + 1, "http://z/", "<p>one</p>"), (None, "http://z/", "<p>two</p>"), (2**60 + 3, "http://z/", None)]
    assert {(r.page_id, r.text) for r in html_text.extract_text(spark.createDataFrame(big, "page_id long, url string, html string")).collect()} == {(2**60 + 1, "one"), (None, "two"), (2**60 + 3, "")}
    assert got[60] == [("one two three four five", 23)] * 7 and not any(notice in x[0][0] for x in got.values())


def test_empty_tables(spark, tmp_path):
    docs = docs_of(spark, [(1, "x", "en")]).where("doc_id < 0")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    some = docs_of(spark, [(i, "of the and " * 9, "en") for i in range(3)])
    assert decontaminate.contained_items(docs, items).count() == decontaminate.contained_items(some, items).count() == 0
    assert quality.score_quality(docs, labels).count() == 0 and {r.score for r in quality.score_quality(some, labels).collect()} == {0.5}
    assert language_id.fit_language_model(docs) == (None, []) and language_id.predict_language(docs, (None, [])).count() == 0
    assert toxicity.fit_toxicity(docs, labels) is None and toxicity.score_toxicity(docs, None).count() == 0
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.read_back(chat.chat_examples(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))).count() == 0
    prints = audio.fingerprints(spark.createDataFrame([], "id long, pcm array<float>"), "id", "pcm")
    assert audio.align(prints, prints).count() == audio.members(prints).count() == 0
    assert ngram_join.one_of_each(docs).count() == packing.pack(docs, tokens.tokenizer_path()).count() == 0


def shingles(text, k):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_pipeline_equals_plain_loops(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline as pipeline

    rng = random.Random(8)
    item = prose(rng, 30)
    rows = [(i, prose(rng, rng.randint(60, 120), (AL, UMLAUT)[i % 2]) + (" !! 99 || <> " * 9 if i % 5 == 0 else "."), ("en", "de")[i % 2]) for i in range(80)]
    rows += [(200, rows[2][1] + " tail", "en"), (201, rows[2][1], None), (202, prose(rng, 50) + " " + item + " " + prose(rng, 50) + ".", "en"), (203, None, "en"), (204, "12 34", "en"), (205, prose(rng, 3000) + ".", "en"), (None, prose(rng, 70) + ".", "en")]
    labels = [(i, int(i % 5 != 0), 0) for i in range(80)] + [(None, 1, None), (11, None, None)]
    docs_of(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    # The networks' weights are the only thing taken from the stages.
    docs = docs_of(spark, rows)
    net, langs = language_id.fit_language_model(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1").select("doc_id", "text", "lang"))
    kept = []
    for r in rows:
        total, n = np.zeros(len(langs)), 0
        for w in re.findall(rb"[a-z\x80-\xff]+", (r[1] or "").lower().encode()):
            for part, a, z in language_id.word_windows(w):
                total += net.positions(*language_id.padded([part]))[a:z, 0].sum(0)
                n += z - a
        if n and (total / n).max() >= 0.3:
            kept.append(r)
    stage = pipeline.language(spark, docs, str(tmp_path))
    assert stage.columns == docs.columns and sorted((r.doc_id or -1) for r in stage.collect()) == sorted((r[0] or -1) for r in kept)
    assert {203, 204}.isdisjoint(r[0] for r in kept) and len(kept) == len(rows) - 2

    scores = plain_quality(kept, [(i, q) for i, q, _ in labels])
    good = [r for r, s in zip(kept, scores) if s >= 0.3]
    stage = pipeline.quality(spark, docs_of(spark, kept), str(tmp_path))
    assert stage.columns == docs.columns and sorted((r.doc_id or -1) for r in stage.collect()) == sorted((r[0] or -1) for r in good)
    assert 0 < len(good) < len(kept) and all(any(r[0] == i for r in good) for i in (2, 201, 202))

    sets = [shingles(r[1].replace("_", " "), 5) for r in good]
    words = [re.findall(rb"[^\x20\x09-\x0D]+", r[1].encode().lower()) for r in good]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    group = list(range(len(good)))
    for i in range(len(good)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    order = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0))
    first = {}
    for i in order:
        first.setdefault(group[i], i)
    alone = [good[i] for i in sorted(first.values())]
    stage = pipeline.near_duplicates(spark, docs_of(spark, good), str(tmp_path))
    assert stage.columns == docs.columns and sorted((r.doc_id or -1) for r in stage.collect()) == sorted((r[0] or -1) for r in alone)
    assert {200, 201}.isdisjoint(r[0] for r in alone)

    asked = shingles(item, 5)
    clean = [r for r in alone if r[0] is None or 100 * len(asked & shingles(r[1], 5)) < 80 * len(asked)]
    stage = pipeline.decontamination(spark, docs_of(spark, alone), str(tmp_path))
    assert stage.columns == docs.columns and sorted((r.doc_id or -1) for r in stage.collect()) == sorted((r[0] or -1) for r in clean)
    assert len(clean) == len(alone) - 1

    tool = Tokenizer.from_file(tokens.tokenizer_path())
    want = []
    for i, t, _ in clean:
        ids = [*tool.encode(t, add_special_tokens=False).ids, 0]
        want += [(i or -1, a // 2048, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for a in range(0, len(ids), 2048)]
    for out in (pipeline.packing(spark, docs_of(spark, clean), str(tmp_path)), pipeline.run(spark, str(tmp_path))):
        made = out.collect()
        assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in made) == sorted(want)
        places = {}
        for r in made:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert all(sum(n for _, n in x) <= 2048 and [a for a, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] for x in places.values())
        assert len(places) <= -(-sum(w[3] for w in want) // 2048) + 1
