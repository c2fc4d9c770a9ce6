import random
import re
import zlib

import numpy as np
import pytest

from simloom.llm import audio, chat, decontaminate, html_text, language_id, ngram_join, packing, quality, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, id long, key int, n string"
AL = "the of and a thou shalt not never ever more quick brown fox jumps over lazy dog".split()


def docs_of(spark, texts):
    """Documents with extra columns whose names clash with those used within."""
    return spark.createDataFrame([(i, t, "en", None, None, "x", 5, 1, None) for i, t in enumerate(texts)], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(AL) + rng.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(2)
    base = prose(rng, 60)
    return [None, "", "  \n ", "one", "one", "1 2 3", base, base, base + " tail", base.upper(), prose(rng, 30_000), "İ Σ <|endoftext|> it's\x1cx"]


def brute_components(texts, k, t):
    sets = []
    for x in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (x or "").encode().lower())
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_op4_equals_brute_force(spark, odd, monkeypatch):
    rng = random.Random(3)
    base = prose(rng, 80).split()
    near = [" ".join(w if rng.random() > 0.02 else "zz" + str(rng.randrange(99)) for w in base) for _ in range(60)]
    short = [prose(rng, rng.randint(1, 12)) for _ in range(40)]
    texts = odd + near + short + [s + " more" for s in short]
    monkeypatch.setattr(ngram_join, "CROWD", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 500)
    # Common runs in sets that are else different, so that keys of many members have members from several homes.
    shared = [prose(rng, 9) for _ in range(4)]
    texts += [" ".join(rng.sample(shared, 2)) + " " + prose(rng, rng.randint(0, 4)) for _ in range(70)]
    for k, t in ((4, 85), (2, 60)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs_of(spark, texts), k, t).collect()}
        assert [got[i] for i in range(len(texts))] == brute_components(texts, k, t)
    assert ngram_join.ngram_components(docs_of(spark, texts).where("doc_id < 0")).count() == 0


def test_op4_long_texts_in_pieces(odd):
    rng = random.Random(4)
    texts = [(t or "").encode() for t in odd] + [("x" * 900 + " " + prose(rng, 60) + "  " + "y" * 500 + " tail").encode(), b"z" * 2000, b" " * 700 + b"a b"]
    for k in (2, 4):
        whole = ngram_join.Shingler(k, 1 << 20).sets(texts)
        for block in (7, 64, 500):
            assert all(np.array_equal(a, b) for a, b in zip(whole, ngram_join.Shingler(k, block).sets(texts), strict=True))


def test_op1_and_op5_exact(spark, odd):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path()
    tool = Tokenizer.from_file(path)
    ids = [(tool.encode(t, add_special_tokens=False).ids if t else []) for t in odd]
    hist = tokens.length_histogram(docs_of(spark, odd), path)
    for limit in (0, 1, 50, 10**6):
        assert tokens.truncated_total(hist, limit) == sum(min(len(x), limit) for x in ids)
    assert tokens.length_quantile(hist, 0.5) == sorted(map(len, ids))[(len(ids) + 1) // 2 - 1]
    rows = packing.pack(docs_of(spark, odd), path).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    for i, x in enumerate(ids):
        raw = np.array([*x, 0], "<u4").tobytes()
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == [(a, min(2048, len(x) + 1 - a)) for a in range(0, len(x) + 1, 2048)]
        assert all(r.ids_crc32 == zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)]) for r in own)
    for own in by_bin.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and sum(r.length for r in own) <= 2048
    assert packing.pack(docs_of(spark, odd).where("doc_id < 0"), path).count() == 0


def test_op2(spark, odd):
    rng = random.Random(5)
    item = prose(rng, 40)
    texts = [*odd, prose(rng, 300) + " " + item.upper().replace(" ", ", ") + " " + prose(rng, 300), " ".join(item.split()[:34]), " ".join(item.split()[:20])]
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "one"), (None, item)], "item_id int, text string")
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in decontaminate.contained_items(docs_of(spark, texts), items).collect()}
    n = len(odd)
    assert got == {(n, 1): (36, 36), (n + 1, 1): (36, 30), (3, 4): (1, 1), (4, 4): (1, 1)}
    inside = [prose(rng, 50) + " Zig, zag ZOG " + prose(rng, 50), "zig zag", "zag zog zig zag", prose(rng, 3) + " zog"]
    short = spark.createDataFrame([(1, "zig zag zog"), (2, "zog"), (3, "zig zag")], "item_id int, text string")
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in decontaminate.contained_items(docs_of(spark, inside), short).collect()}
    assert got == {(d, i): (1, 1) for d, i in ((0, 1), (0, 2), (0, 3), (1, 3), (2, 2), (2, 3), (3, 2))}
    kept = decontaminate.decontaminated(docs_of(spark, texts), items)
    assert kept.columns == docs_of(spark, texts).columns and kept.count() == len(texts) - 4


def test_op7_gradients_and_labels(spark, odd):
    net = language_id.BiGru(2, hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, lengths = language_id.padded([b"abc", b"de"])
    y, w = np.array([0, 1]), np.ones(2)
    loss = lambda: -np.mean([np.log(net.positions(x, lengths)[t, i, y[i]]) for i in range(2) for t in range(lengths[i])])
    g = net.gradients(x, lengths, y, w)
    for name, at in (("xf", (97, 1)), ("hb", (0, 7)), ("hf", (1, 2)), ("o", (2, 1)), ("xb", (100, 4))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = loss()
        net.p[name][at] = old - 1e-3
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-3 - g[name][at]) < 1e-3
    words = [b"uvu", b"vuv", b"xyx", b"yxy"] * 30
    model = language_id.BiGru(2).fit(words, np.array([0, 0, 1, 1] * 30), np.ones(120), steps=60, batch=32), ["aa", "bb"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict_language(docs_of(spark, ["uvuv vuvu", "xyxy! yx", *odd]), model).collect()}
    assert got[0][0] == "aa" and got[1][0] == "bb" and got[2] == ("und", 0.0) and got[7] == ("und", 0.0)
    assert language_id.predict_language(docs_of(spark, odd), (None, [])).where("lang_pred != 'und'").count() == 0


def test_op3_and_op9(spark, odd):
    rng = random.Random(6)
    bad = [" ".join(rng.choice(AL).upper() + "!!" for _ in range(60)) for _ in range(60)]
    good = [prose(rng, 60) + "." for _ in range(60)]
    labels = spark.createDataFrame([(i, int(i >= 60), None) for i in range(120)] + [(999, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs_of(spark, bad + good + odd), labels).collect()
    assert len(got) == 120 + len(odd) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == int(r.doc_id >= 60) for r in got if r.doc_id < 120 and r.held_out]) == 1
    assert {r.score for r in quality.score_quality(docs_of(spark, odd), labels.where("doc_id < 0")).collect()} == {0.5}
    mean = [prose(rng, 40) + " blockhead " + prose(rng, 40) for _ in range(120)]
    fine = [prose(rng, 80) for _ in range(200)]
    rows = spark.createDataFrame([(i, int(i < 120)) for i in range(320)], "doc_id long, toxic int")
    slopes = toxicity.fit_toxicity(docs_of(spark, mean + fine), rows)
    probe = [prose(rng, 50) + " blockheads", prose(rng, 90), *odd[:3]]
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(docs_of(spark, probe), slopes).collect()}
    assert score[0] > 0.5 > score[1] and score[2] == score[3] == score[4] == 0
    assert toxicity.fit_toxicity(docs_of(spark, fine), rows.where("toxic = 9")) is None


def test_op8(spark):
    notice = "We use cookies to make this site better for all of you"
    head = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href='/x'>menu</a></nav><div class='ad'>buy</div>"
    pages = [f"{head}<article><h1>Title {i}</h1><p>Own   text &amp; more {i}<br>here &lt;b&gt;</p><p>{' '.join(f'w{i}x{j}' for j in range(20))}</p><p>{notice}</p><div class='comments'><p>first!</p></div></article><footer>f</footer></body></html>" for i in range(8)]
    plain = [f"<body><p>{notice}</p><p>only page {w} says {w} words</p></body>" for w in ("a1", "b2", "c3", "d4", "e5", "f6")]
    rows = [(i, "http://h.example/%d" % i, p) for i, p in enumerate(pages)] + [(100 + i, "http://p.example/", p) for i, p in enumerate(plain)] + [(200, None, None), (201, "u", ""), (202, "u", "<article><p>cut off &am")]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")).collect()}
    assert got[3] == "Title 3\nOwn text & more 3 here <b>\n" + " ".join(f"w3x{j}" for j in range(20))
    assert got[100] == "only page a1 says a1 words" and got[200] == got[201] == "" and got[202] == "cut off &am"


def test_op8_suffix_array_equals_brute_force():
    rng = random.Random(1)
    for trial in range(40):
        streams = [[rng.choice("ab" if trial % 2 else "abc") for _ in range(rng.randint(0, 22))] for _ in range(rng.randint(1, 6))]
        texts = ["".join(s) for s in streams]
        pieces = [(i, a, n) for i, t in enumerate(texts) for a in range(len(t)) for n in range(4, len(t) - a + 1)]
        pages = {(i, a, n): sum(texts[i][a : a + n] in t for t in texts) for i, a, n in pieces}
        for least in (1, 3):
            got = html_text.Suffixes(streams, least).pages(*np.array(pieces, np.int64).reshape(-1, 3).T, least=least).tolist()
            assert got == [pages[p] if pages[p] >= least else 0 for p in pieces]
        times = lambda x: sum(t.startswith(x, a) for t in texts for a in range(len(t)))
        held = {texts[i][a : a + n]: c for (i, a, n), c in pages.items() if c > 1}
        want = {(x, c) for x, c in held.items() if all(times(x + y) < times(x) for y in "abc")}
        whole = "".join(texts)
        assert {(whole[p : p + n], c) for p, n, c in html_text.Suffixes(streams).maximal_repeats(2)} == want


@pytest.mark.parametrize("page, want", [
    ("<body class='home page-template sidebar-right'><article><p>A b</p></article></body>", "A b"),
    ("<body class='single-post nav-open'><div class='has-cookie-banner'><article>A</article></div></body>", "A"),
    ("<article class='post social-post'><p>A</p></article>", "A"),
    ("<main id='search'><p>A</p></main>", "A"),
    ("<nav><ul><li>x<article><p>A</p></article>", "A"),
    ("<nav>x</nav><form id='aspnet'><article>A</article></form>", "A"),
    ("<aside><article>teaser</article></aside><article>A <span class='ad'>buy</span> b<br>c</article>", "A b c"),
    ("<body><p class='share price'>The price</p><div class='ad'>no</div><div class='share-links x'><a href=1>f</a> <a>g</a></div></body>", "The price"),
    ("<article>A<header><h1>T</h1></header><p class=ad>no<p>b<div class='comments'><p>no</div>c</article>", "A\nT\nb\nc"),
    ("<div data-id='ad'>A</div><p hidden>no</p><p style='display: none'>no</p>", "A"),
])
def test_op8_elements(page, want):
    assert "\n".join(t for _, t in html_text.main_part(html_text.blocks(page))) == want


def test_op8_keeps_copies_without_article(spark):
    rng = random.Random(7)
    notice = "We use cookies to make this site better for all of you"
    text, near = prose(rng, 60), prose(rng, 120).split()
    close = [" ".join([*near[:50], f"edit{i}", *near[51:]]) for i in range(6)]
    hosts = {"a": [f"<body><p>{text}</p></body>"] * 5, "b": [f"<body><p>{' '.join(near[:40])}</p><p>{c}</p></body>" for c in close]}
    hosts["c"] = [f"<body><p>{notice}</p><p>{text}</p></body>"] * 6 + [f"<body><p>{notice}</p><p>{prose(rng, 40)}</p></body>" for _ in range(8)]
    rows = [(h, f"http://{h}/", p) for h, own in hosts.items() for p in own] + [("n", None, f"<body>{text}</body>")] * 5
    made = html_text.extract_text(spark.createDataFrame([(i, u, p) for i, (_, u, p) in enumerate(rows)], "page_id long, url string, html string")).collect()
    got = {h: [r.text for r in sorted(made) if rows[r.page_id][0] == h] for h in "abcn"}
    assert got["a"] == got["n"] == [text] * 5 and got["c"][:6] == [text] * 6
    assert got["b"] == [" ".join(near[:40]) + "\n" + c for c in close]
    assert not any(notice in x for x in got["c"])


def test_op8_decides_by_whole_hosts(spark, monkeypatch):
    rng = random.Random(9)
    notice = "We use cookies to make this site better for all of you"
    page = lambda text: f"<body><p>{notice}</p><p>{text}</p></body>"
    long, copy = [prose(rng, 120) for _ in range(6)], prose(rng, 150).split()
    rows = [("http://h/", page(x)) for x in long] + [("http://small/", page("one page"))]
    rows += [(None, page(prose(rng, 100))) for _ in range(20)] + [(None, page(" ".join([*copy[:70], f"edit{i // 2}", *copy[71:]]))) for i in range(30)] + [(None, None)]
    # A text that some pages have as a block and others within a longer one, so that no shard need have enough of either.
    rows += [("http://part/", f"<body><p>{notice + (' ' + prose(rng, 5) if i % 3 else '')}</p><p>{prose(rng, 50)}</p></body>") for i in range(24)]
    rows += [("http://m/", page(f"{prose(rng, 60)}</p><p>{' '.join(copy[:20]) if i < 3 else prose(rng, 9)}")) for i in range(12)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    whole = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    for size in (7000, 300):
        monkeypatch.setattr(html_text, "SHARD_BYTES", size)
        assert {r.page_id: r.text for r in html_text.extract_text(df).collect()} == whole
    monkeypatch.setattr(html_text, "SHARD_BYTES", 1000)
    made = html_text.extract_text(df).collect()
    got = {r.page_id: r.text for r in made}
    assert len(made) == len(rows) and [got[i] for i in range(6)] == long
    part = range(58, 82)
    assert got == whole and notice in got[6] and not any(notice in t for i, t in got.items() if i != 6 and i not in part)
    assert [notice in got[i] for i in part] == [True] * 24 or [notice in got[i] for i in part] == [bool(i % 3) for i in range(24)]
    assert all(len(got[i].split()) == 150 for i in range(27, 57)) and [r.n_chars for r in made] == [len(r.text) for r in made]


def test_op10(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "a\\</s>", "<", "[/INST", None, "", "x</s"]
    rows = [(1, i, ["system", "user", "assistant"][i % 3], t, 0) for i, t in enumerate(hard)] + [(2, 0, None, None, 0), (3, 0, "assistant", "hi", 0), (3, 0, "assistant", "hi", 0)]
    made = chat.chat_examples(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, example int"))
    texts = {(r.conv_id, r.example): r for r in made.collect()}
    assert len([k for k in texts if k[0] == 1]) == 3 and len([k for k in texts if k[0] == 3]) == 2
    assert chat.parse(texts[1, 2].text) == [(["system", "user", "assistant"][i % 3], t or "") for i, t in enumerate(hard)]
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert back[1].n_turns == 8 and back[1].loss_chars == len("a\\</s>") + 0 and back[2].loss_chars == 0
    assert chat.read_back(made.where("conv_id < 0")).count() == 0


def test_op6(spark):
    rng = np.random.default_rng(3)
    song = audio.melody(rng.normal(0, 1, 64).tolist(), notes=48)
    other = audio.melody(rng.normal(0, 1, 64).tolist(), notes=48)
    late = song[audio.HOP * 10 :] + rng.normal(0, 0.01, len(song) - audio.HOP * 10).astype(np.float32)
    rows = [(0, song.tolist()), (1, late.tolist()), (2, other.tolist()), (3, None), (4, []), (5, song.tolist())]
    prints = audio.fingerprints(spark.createDataFrame(rows, "id long, pcm array<float>"), "id", "pcm")
    got = {r.class_id: (r.offset, r.bit_error, r.class_size) for r in audio.align(prints.where("id = 0"), prints).collect()}
    assert set(got) == {0, 1} and got[0] == (0, 0.0, 2) and got[1][0] == -10 and got[1][1] < 0.15


def test_op6_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    songs = [audio.melody(rng.normal(0, 1, 24).tolist()) for _ in range(5)]
    tone = np.sin(2 * np.pi * 440 * np.arange(4 * audio.RATE) / audio.RATE).astype(np.float32)
    cells = [*songs, *(x[audio.HOP * 6 :] + rng.normal(0, 0.05, len(x) - audio.HOP * 6).astype(np.float32) for x in songs), songs[0][: audio.FRAME], np.zeros(3 * audio.RATE, np.float32), tone, tone]
    rows = [(i, x.tolist(), 7, "x") for i, x in enumerate(cells)]
    prints = audio.fingerprints(spark.createDataFrame(rows, "id long, pcm array<float>, at int, fp string"), "id", "pcm")
    fp = {r.id: np.array(r.fp, np.int32).view(np.uint32) for r in prints.collect()}
    got = {(r.query_id, r.class_id): (r.offset, r.votes, r.bit_error) for r in audio.align(prints, prints).collect()}

    def pairs(x):
        s = np.uint32(audio.SILENT & 0xFFFFFFFF)
        return [(lag, i, (x[i], x[i + lag])) for lag in audio.LAGS for i in range(len(x) - lag) if (i == 0 or (x[i - 1], x[i - 1 + lag]) != (x[i], x[i + lag])) and not x[i] == x[i + lag] == s]

    want = {}
    for q, a in fp.items():
        for c, b in fp.items():
            if c == 13 or not len(a) or not len(b):  # 13 is of the class of 12
                continue
            votes = {}
            for lag, i, x in pairs(a):
                for other, j, y in pairs(b):
                    if (lag, x) == (other, y):
                        votes[j - i] = votes.get(j - i, 0) + 1
            if votes:
                shift = min(votes, key=lambda k: (-votes[k], k))
                lo, hi = max(0, -shift), min(len(a), len(b) - shift)
                error = sum(bin(int(x ^ y)).count("1") for x, y in zip(a[lo:hi], b[lo + shift : hi + shift])) / 32 / (hi - lo)
                if error <= 0.3:
                    want[q, c] = (shift, votes[shift], error)
    assert got == want and all((i, 5 + i) in got and got[i, 5 + i][0] == -6 for i in range(5))
    assert not any(11 in k for k in got) and (12, 12) in got and (13, 12) in got
    assert audio.align(prints.where("id < 0"), prints).count() == audio.align(prints, prints.where("id < 0")).count() == audio.members(prints.where("id < 0")).count() == 0


def test_op6_covers_whole_vectors():
    vector = np.random.default_rng(4).normal(0, 1, 64).tolist()
    late = vector[:48] + [x + 0.005 for x in vector[48:]]
    assert len(audio.melody(vector)) == 64 * audio.RATE // 8
    one, two = (audio.fingerprint(audio.chroma(audio.melody(v))) for v in (vector, late))
    assert len(one) == len(two) and (one != two).any() and (one == two).any()


def test_op6_names_members_of_classes(spark, tmp_path):
    rng = np.random.default_rng(5)
    one, two = (rng.normal(0, 1, 64).tolist() for _ in range(2))
    rows = [(0, one), (7, two), (17, one), (512, one), (600, two), (601, []), (602, None), (None, two)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = audio.op6_audio_fingerprints(spark, str(tmp_path)).collect()
    classes = [(r.recording_id, r.class_id) for r in got if r.query_id is None]
    assert sorted(classes, key=str) == sorted([(0, 0), (17, 0), (512, 0), (7, 7), (600, 7), (None, 7), (601, None), (602, None)], key=str)
    assert {(r.query_id, r.class_id, r.class_size) for r in got if r.query_id is not None and r.bit_error == 0} == {(0, 0, 3), (600, 7, 3)}


def test_pipeline_near_duplicates_equal_brute_force(spark, odd):
    import corpus_pipeline

    docs = docs_of(spark, odd)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    want = [i for i, (_, least) in enumerate(brute_components(odd, 5, 80)) if i == least]
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == want


def test_one_of_each_of_repeated_and_null_ids(spark):
    rng = random.Random(11)
    one, two, three = (prose(rng, 40) for _ in range(3))
    rows = [(5, one), (5, one), (2, one + " more"), (None, one), (None, two), (None, two), (7, three), (7, two + " x"), (None, None), (9, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row0 int")
    kept = ngram_join.one_of_each(docs)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert kept.columns == docs.columns
    assert got == sorted([(2, one + " more"), (7, two + " x"), (7, three), (None, None), (9, ""), (9, "")], key=str)


def test_op5_count_of_sequences(spark):
    """As few as one global best-fit makes, by about one in a hundred, however the bins are dealt."""
    rng = random.Random(12)
    texts = [prose(rng, rng.choice([3, 10, 40, 150, 300, 450])) for _ in range(500)]
    docs, path = docs_of(spark, texts).repartition(12), tokens.tokenizer_path()
    counts = {}
    for most in (10**6, 40, 15):
        rows = packing.pack(docs, path, slack=4, fan_in=3, most_items=most).select("sequence_id", "length", "offset").collect()
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert all(sum(n for _, n in x) <= 2048 and [a for a, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:i]) for i in range(len(x))] for x in by.values())
        counts[most] = len(by)
        sizes = np.array([r.length for r in rows])
    best = len(packing.best_fit(sizes, 2048)[2])
    assert best >= -(-sizes.sum() // 2048)
    assert all(best <= n <= best * 1.03 + 1 for n in counts.values())


def test_op7_long_words_by_windows():
    net = language_id.BiGru(2, hidden=3)
    word = bytes(np.random.default_rng(1).integers(97, 123, 3 * language_id.SPAN + 5))
    windows = language_id.word_windows(word)
    assert b"".join(w[a:z] for w, a, z in windows) == word and all(len(w) <= language_id.SPAN + 2 * language_id.CONTEXT for w, _, _ in windows)
    want = np.zeros(2)
    for w, a, z in windows:
        want += net.positions(*language_id.padded([w]))[a:z, 0].sum(0)
    got = net.word_sums([b"x", word, b"yy"])[1]
    assert np.allclose(got[:2], want, atol=1e-5) and got[2] == len(word)


def test_op7_pooling_equals_whole_texts(spark, odd):
    """Scores against a plain loop over every word of every text, without the cache of words."""
    net, langs = language_id.BiGru(3, hidden=4, seed=2), ["aa", "bb", "cc"]
    texts = [t for t in odd if t is not None and len(t) < 5000] + ["ab Cd ab, e1f", "語" * 70 + " é"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict_language(docs_of(spark, [*texts, *texts[-2:]]), (net, langs)).collect()}
    for i, t in enumerate(texts):
        total, n = np.zeros(3), 0
        for w in re.findall(rb"[a-z\x80-\xff]+", t.lower().encode()):
            for part, a, z in language_id.word_windows(w):
                total += net.positions(*language_id.padded([part]))[a:z, 0].sum(0)
                n += z - a
        letters = any(c.isalpha() for c in t)
        assert got[i][0] == (langs[int((total / n).argmax())] if letters else "und")
        assert abs(got[i][1] - ((total / n).max() if letters else 0)) < 1e-5
    assert got[len(texts)] == got[len(texts) - 2] and got[len(texts) + 1] == got[len(texts) - 1]


def test_op10_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat, "BATCH_CHARS", 300)
    rows = [(1, i, "assistant" if i % 2 else "user", "w" * 40) for i in range(60)]
    made = chat.chat_examples(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    back = chat.read_back(made).collect()
    assert made.count() == 30 and [(r.n_turns, r.loss_chars) for r in back] == [(60, 1200)]
