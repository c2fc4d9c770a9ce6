"""Toxicity classifier: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its hashed n-grams of 3 to 8 bytes and of the word itself, so
an unseen misspelling shares most vectors with the word it misspells. Of a text's distinct words, in order, each window of
``WINDOW`` averages its words' vectors and a linear softmax gives its chance of being toxic; a document is toxic unless all of
its windows are clean (noisy or), so a few words count in a text of any length. (With one average over a whole document, a few
words among hundreds are lost; README has the figures of both.) Vectors and softmax are
trained jointly in numpy on a bounded sample: at most ``toxic_docs`` and ``clean_docs`` labelled texts of
up to ``max_chars`` characters, those of lowest id hash. All rows are scored over their whole texts.

Against learning texts by heart, an n-gram counts only if ``FEWEST`` texts of the sample have it, and a step moves all vectors at one
rate: its length is the rate, so n-grams that many toxic texts share grow and those of single texts stay small. (A rate for each
weight of its own, as Adam has, moves the rarest n-grams as far as the most telling.)

Defined results: null, empty and wordless texts score 0; rows with a null label or id are not learned from; repeated
rows are scored alike; without labels of both kinds, or without a word in either kind's texts, every score is 0; an empty table
gives no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm.common import fold, in_arrow, read_table

BUCKETS, WIDTH, WINDOW, LONGEST, FEWEST = 1 << 20, 4, 2, 32, 3
NGRAMS = (3, 4, 5, 6, 7, 8)


def word_map() -> bytes:
    """Byte map that keeps letters, digits, @, and bytes over 127 and turns all others into a space."""
    keep = {*range(65, 91), *range(97, 123), *range(48, 58), 64, *range(128, 256)}
    return bytes(b if b in keep else 32 for b in range(256))


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' character n-grams, word after word, and how many each word has. A word over ``LONGEST`` bytes counts by its pieces."""
    owner = [(i, w[a : a + LONGEST]) for i, w in enumerate(words) for a in range(0, max(len(w), 1), LONGEST)]
    lengths = np.fromiter((len(w) + 2 for _, w in owner), np.int64, len(owner))
    width = int(lengths.max(initial=2))
    chars = np.frombuffer(b"".join((b"<" + w + b">").ljust(width, b"\0") for _, w in owner), np.uint8).reshape(len(owner), width).astype(np.uint64)
    at = np.fromiter((i for i, _ in owner), np.int64, len(owner))
    found, places = [], []
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(width, 0x9E3779B97F4A7C15, np.uint64))
        for n in NGRAMS:
            if width >= n:
                h = sum(chars[:, j : width - n + 1 + j] * powers[j] for j in range(n)) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(n)
                fits = np.arange(width - n + 1) + n <= lengths[:, None]
                found.append(h[fits])
                places.append(np.broadcast_to(at[:, None], fits.shape)[fits])
        found.append((chars * powers).sum(1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        places.append(at)
        h, place = np.concatenate(found), np.concatenate(places)
        bucket = ((h ^ (h >> np.uint64(29))) >> np.uint64(7)) & np.uint64(BUCKETS - 1)
    order = np.argsort(place, kind="stable")
    return bucket[order].astype(np.int32), np.bincount(place, minlength=len(words))


def windows(counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Window of each word and document of each window, for documents of so many words."""
    per = [-(-c // WINDOW) for c in counts]
    first = np.concatenate([[0], np.cumsum(per)[:-1]]) if per else np.zeros(0)
    word_window = np.concatenate([np.arange(c) // WINDOW + f for c, f in zip(counts, first)]) if counts else np.zeros(0)
    return word_window.astype(np.int64), np.repeat(np.arange(len(per)), per)


class SubwordSoftmax:
    """Parameters: ``e``, a vector for each learned n-gram, ``w`` and ``b`` of the softmax; ``learned``, the n-grams' buckets."""

    def __init__(self, seed: int = 5):
        self.rng = np.random.default_rng(seed)
        self.p = {"w": self.rng.normal(0, 0.3, (WIDTH, 2)).astype(np.float32), "b": np.array([2.0, -2.0], np.float32)}
        self.learned = np.zeros(0, np.int64)

    def prepared(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text's distinct words; sets the vocabulary and the words' learned n-grams."""
        table = word_map()
        split = [list(dict.fromkeys(t.translate(table).split())) for t in texts]
        names = sorted(set().union(*split))
        ids = {w: i for i, w in enumerate(names)}
        docs = [np.fromiter(map(ids.__getitem__, w), np.int64, len(w)) for w in split]
        made = [subwords(names[a : a + 20_000]) for a in range(0, len(names), 20_000)]
        counts = np.concatenate([c for _, c in made]) if made else np.zeros(0, np.int64)
        bucket = np.concatenate([x for x, _ in made]) if made else np.zeros(0, np.int32)
        starts = np.concatenate([[0], np.cumsum(counts)])
        held = np.zeros(BUCKETS, np.int32)
        for d in docs:
            if len(d):
                held[np.unique(np.concatenate([bucket[starts[i] : starts[i + 1]] for i in d]))] += 1
        self.learned = np.flatnonzero(held >= FEWEST)
        known = held[bucket] >= FEWEST
        self.starts = np.concatenate([[0], np.cumsum(known)])[starts]
        self.gram = np.searchsorted(self.learned, bucket[known]).astype(np.int32)
        self.p["e"] = self.rng.normal(0, 0.05, (len(self.learned), WIDTH)).astype(np.float32)
        return docs

    def forward(self, docs: list[np.ndarray]) -> dict:
        """Of some texts: words used, their n-grams and vectors, windows, and each window's logit difference."""
        used, flat = np.unique(np.concatenate(docs), return_inverse=True)
        counts = self.starts[used + 1] - self.starts[used]
        own = self.gram[np.repeat(self.starts[used] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())]
        word, n = np.repeat(np.arange(len(used)), counts), np.maximum(counts, 1)[:, None]
        vec = np.stack([np.bincount(word, self.p["e"][own, k], len(used)) for k in range(WIDTH)], 1) / n
        place, doc = windows([len(d) for d in docs])
        size = np.bincount(place)
        z = (vec @ (self.p["w"][:, 1] - self.p["w"][:, 0]))[flat]
        d = np.bincount(place, z) / size + self.p["b"][1] - self.p["b"][0]
        return {"flat": flat, "own": own, "word": word, "n": n, "vec": vec, "place": place, "doc": doc, "size": size, "d": d}

    def loss(self, docs: list[np.ndarray], y: np.ndarray, cost: np.ndarray) -> float:
        x = self.forward(docs)
        clean = np.bincount(x["doc"], np.logaddexp(0, x["d"]), len(docs))  # -log of the chance that all windows are clean
        return float((np.where(y == 1, -np.log(-np.expm1(-clean)), clean) * cost).sum() / cost.sum())

    def gradients(self, docs: list[np.ndarray], y: np.ndarray, cost: np.ndarray) -> dict:
        x = self.forward(docs)
        clean = np.bincount(x["doc"], np.logaddexp(0, x["d"]), len(docs))
        slope = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(clean, 500)), 1e-6), 1.0) * cost / cost.sum()
        dd = slope[x["doc"]] / (1 + np.exp(-x["d"]))
        g = np.bincount(x["flat"], (dd / x["size"])[x["place"]], len(x["vec"]))
        side = np.stack([-g, g], 1)
        dvec = (side @ self.p["w"].T) / x["n"]
        de = np.stack([np.bincount(x["own"], dvec[x["word"], k], len(self.learned)) for k in range(WIDTH)], 1)
        return {"e": de.astype(np.float32), "w": x["vec"].T @ side, "b": np.array([-dd.sum(), dd.sum()])}

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int = 360, batch: int = 200, rates: dict | None = None, seed: int = 9) -> SubwordSoftmax:
        """rates: the length of the first step of the vectors and of the softmax; it falls to 0."""
        rates = rates or {"e": 10.0, "w": 0.05, "b": 0.05}
        docs = self.prepared(texts)
        keep = [i for i, d in enumerate(docs) if len(d)]
        if not {0, 1} <= set(y[keep].tolist()):
            self.learned = self.learned[:0]
            return self
        cost = np.where(y == 1, (y == 0).sum() / max((y == 1).sum(), 1), 1.0) ** 0.5
        rng, mean, square, order = np.random.default_rng(seed), {}, {}, np.zeros(0, np.int64)
        for i in range(1, steps + 1):
            if not len(order):
                order = rng.permutation(keep)
            rows, order = order[:batch], order[batch:]
            for k, v in self.gradients([docs[r] for r in rows], y[rows], cost[rows]).items():
                mean[k] = 0.9 * mean.get(k, 0) + 0.1 * v
                square[k] = 0.98 * square.get(k, 0) + 0.02 * float((v * v).sum())
                length = rates[k] * (1 - (i - 1) / steps) / (np.sqrt(square[k] / (1 - 0.98**i)) + 1e-9)
                self.p[k] -= (length * mean[k] / (1 - 0.9**i)).astype(np.float32)
        return self

    def slopes(self) -> tuple[np.ndarray, float] | None:
        """Per bucket the difference of the two logits (NaN: not learned), and the bias's: all that scoring needs."""
        if not len(self.learned):
            return None
        out = np.full(BUCKETS, np.nan, np.float32)
        out[self.learned] = self.p["e"] @ (self.p["w"][:, 1] - self.p["w"][:, 0])
        return out, float(self.p["b"][1] - self.p["b"][0])


class Scorer:
    """Scores whole texts; keeps up to ``room`` distinct words' scores."""

    def __init__(self, slopes: tuple[np.ndarray, float] | None, room: int = 200_000):
        self.slopes, self.room, self.map, self.known = slopes, room, word_map(), {}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        if self.slopes is None:
            return out
        words = [list(dict.fromkeys((t or "").lower().encode().translate(self.map).split())) for t in texts]
        seen = set().union(*words)
        new = [w for w in seen if w not in self.known]
        if len(self.known) + len(new) > self.room:
            self.known, new = {}, list(seen)
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            bucket, counts = subwords(part)
            value = self.slopes[0][bucket]
            learned = ~np.isnan(value)
            place = np.repeat(np.arange(len(part)), counts)[learned]
            total, n = np.bincount(place, value[learned], len(part)), np.bincount(place, minlength=len(part))
            self.known.update(zip(part, total / np.maximum(n, 1)))
        for i, w in enumerate(words):
            if w:
                s = np.fromiter(map(self.known.__getitem__, w), np.float64, len(w))
                edges = np.arange(0, len(w), WINDOW)
                d = np.add.reduceat(s, edges) / np.diff(np.append(edges, len(w))) + self.slopes[1]
                out[i] = -np.expm1(-np.logaddexp(0, d).sum())
        return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, toxic_docs: int = 2000, clean_docs: int = 4000, max_chars: int = 20_000) -> tuple[np.ndarray, float] | None:
    """Labels: doc_id and toxic, of rows to learn from."""
    rows = []
    for kind, most in ((1, toxic_docs), (0, clean_docs)):
        ids = labels.where(F.col("toxic") == kind).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        rows += [(kind, r[0].lower().encode()) for r in docs.where(F.length("text") <= max_chars).join(F.broadcast(ids), "doc_id").select("text").collect()]
    y = np.array([k for k, _ in rows], np.int64)
    return SubwordSoftmax().fit([t for _, t in rows], y).slopes()


def score_toxicity(docs: DataFrame, slopes: tuple[np.ndarray, float] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    schema = docs.select(id_col).schema.add("score", "double")

    def run(batches):
        tool = Scorer(slopes)
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tool.scores(part.column(1).to_pylist()))], [id_col, "score"])

    return in_arrow(docs.select(id_col, text_col), run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    slopes = fit_toxicity(docs.select("doc_id", "text"), labels.where(fold(F.col("doc_id"), 5) != 0))
    scored = score_toxicity(docs, slopes)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
