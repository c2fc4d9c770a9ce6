"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of each word in both directions, labels every byte position with
a distribution over the languages, and a document's probabilities are the mean over all its
positions. The state starts anew at each word, so a word's labels do not depend on its neighbours:
each distinct word of a batch is run once and weighted by its occurrences, over the whole text. A word of over ``SPAN``
bytes (scripts without spaces) is run in windows that begin ``CONTEXT`` bytes before and end ``CONTEXT`` bytes behind the up to ``SPAN``
bytes they label, so every byte is labelled once, with that much of the word on either side at least.

Training is backpropagation through time in numpy on a bounded sample of labelled words: of the ``most_langs`` most frequent languages
the ``docs_per_lang`` documents of lowest id hash and their ``words_per_lang`` most frequent words, long ones by the same windows.

Defined results: null text or text without a letter gives ``und`` and score 0; nulls in other
columns do not matter; repeated rows are scored alike; an empty table gives no rows; other columns
are never read. Without any labelled row every text is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simloom.llm.common import fold, in_arrow, read_table

SPAN, CONTEXT = 64, 32
HIDDEN = 16
#: Bytes, with padding, that go through the network at once.
CELLS = 1 << 16


def word_table() -> bytes:
    """Byte map that keeps letters and bytes over 127 and turns all others into a space."""
    keep = [*range(65, 91), *range(97, 123), *range(128, 256)]
    return bytes(b if b in set(keep) else 32 for b in range(256))


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
    width = int(lengths.max()) if len(words) else 1
    flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8)
    return flat.reshape(len(words), width).astype(np.int64), lengths


def word_windows(word: bytes) -> list[tuple[bytes, int, int]]:
    """Windows of a word, and of each the first and the end of the bytes it labels."""
    if len(word) <= SPAN:
        return [(word, 0, len(word))]
    starts = range(0, len(word), SPAN)
    return [(word[max(a - CONTEXT, 0) : a + SPAN + CONTEXT], min(a, CONTEXT), min(a, CONTEXT) + min(SPAN, len(word) - a)) for a in starts]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BiGru:
    """Gated recurrent units over bytes in both directions, and a softmax at every position."""

    def __init__(self, n_out: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden, self.n_out = hidden, n_out
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.p[f"h{d}"] = rng.normal(0, 0.3, (hidden, 3 * hidden)).astype(np.float32)
        self.p["o"] = rng.normal(0, 0.2, (2 * hidden, n_out)).astype(np.float32)
        self.p["c"] = np.zeros(n_out, np.float32)

    def _run(self, d: str, x: np.ndarray, live: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States of one direction, [time, word, hidden]; a word's state stays where it has no byte."""
        n, steps, m = len(x), x.shape[1], self.hidden
        wx, wh = self.p[f"x{d}"], self.p[f"h{d}"]
        out = np.zeros((steps, n, m), np.float32)
        h = np.zeros((n, m), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gx, gh, on = wx[x[:, t]], h @ wh[:, : 2 * m], live[:, t, None]
            z = sigmoid(gx[:, :m] + gh[:, :m])
            r = sigmoid(gx[:, m : 2 * m] + gh[:, m:])
            c = np.tanh(gx[:, 2 * m :] + (r * h) @ wh[:, 2 * m :])
            new = np.where(on, z * h + (1 - z) * c, h)
            if tape is not None:
                tape.append((t, h, z, r, c, on))
            h = new
            out[t] = h
        return out

    def positions(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probabilities [time, word, language]."""
        live = np.arange(x.shape[1]) < lengths[:, None]
        both = np.concatenate([self._run("f", x, live), self._run("b", x, live)], axis=2)
        logits = both @ self.p["o"] + self.p["c"]
        e = np.exp(logits - logits.max(2, keepdims=True))
        return e / e.sum(2, keepdims=True) * live.T[:, :, None]

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """Gradient of the weighted cross-entropy at all positions, by backpropagation through time."""
        live, m = np.arange(x.shape[1]) < lengths[:, None], self.hidden
        tapes: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(d, x, live, tapes[d]) for d in "fb"], axis=2)
        logits = both @ self.p["o"] + self.p["c"]
        e = np.exp(logits - logits.max(2, keepdims=True))
        delta = e / e.sum(2, keepdims=True)
        delta[:, np.arange(len(y)), y] -= 1
        delta *= (live.T * weight)[:, :, None] / max(1e-9, float((live * weight[:, None]).sum()))
        g = {"o": np.einsum("tnh,tnk->hk", both, delta), "c": delta.sum((0, 1))}
        dh_all = delta @ self.p["o"].T
        for d in "fb":
            wh, gx = self.p[f"h{d}"], np.zeros_like(self.p[f"x{d}"])
            gh, dh, seen = np.zeros_like(wh), np.zeros((len(x), m), np.float32), []
            for t, h, z, r, c, on in reversed(tapes[d]):
                dh = dh + dh_all[t][:, :m] if d == "f" else dh + dh_all[t][:, m:]
                step = np.where(on, dh, 0)
                dz = step * (h - c) * z * (1 - z)
                dc = step * (1 - z) * (1 - c * c)
                drh = dc @ wh[:, 2 * m :].T
                dr = drh * h * r * (1 - r)
                gates = np.concatenate([dz, dr, dc], axis=1)
                seen.append((x[:, t], gates))
                gh[:, : 2 * m] += h.T @ gates[:, : 2 * m]
                gh[:, 2 * m :] += (r * h).T @ dc
                dh = np.where(on, step * z + drh * r + gates[:, : 2 * m] @ wh[:, : 2 * m].T, dh)
            byte = np.concatenate([b for b, _ in seen])
            order = np.argsort(byte, kind="stable")
            used, first = np.unique(byte[order], return_index=True)
            gx[used] = np.add.reduceat(np.concatenate([v for _, v in seen])[order], first)
            g[f"x{d}"], g[f"h{d}"] = gx, gh
        return g

    def fit(self, words: list[bytes], y: np.ndarray, weight: np.ndarray, steps: int = 700, batch: int = 384, rate: float = 0.01, seed: int = 3) -> BiGru:
        """Adam over minibatches drawn in proportion to ``weight``."""
        rng, mean, square = np.random.default_rng(seed), {}, {}
        x, lengths = padded(words)
        chance = weight / weight.sum()
        drawn = rng.choice(len(words), (steps, batch), p=chance)
        for i in range(steps):
            rows = drawn[i]
            g = self.gradients(x[rows][:, : lengths[rows].max()], lengths[rows], y[rows], np.ones(batch, np.float32))
            step = rate * (1 - i / steps)
            for k, v in g.items():
                mean[k] = 0.9 * mean.get(k, 0) + 0.1 * v
                square[k] = 0.99 * square.get(k, 0) + 0.01 * v * v
                self.p[k] -= (step * (mean[k] / (1 - 0.9 ** (i + 1))) / (np.sqrt(square[k] / (1 - 0.99 ** (i + 1))) + 1e-8)).astype(np.float32)
        return self

    def word_sums(self, words: list[bytes]) -> np.ndarray:
        """Per word the sum of its positions' probabilities, and in the last column its length."""
        out = np.zeros((len(words), self.n_out + 1), np.float64)
        if not words:
            return out
        parts = [(i, *window) for i, w in enumerate(words) for window in word_windows(w)]
        parts.sort(key=lambda q: len(q[1]))
        a = 0
        while a < len(parts):
            z = min(len(parts), a + CELLS // len(parts[min(len(parts), a + 4096) - 1][1]))  # by length: the last of them is the longest
            rows, texts, first, end = zip(*parts[a:z])
            a = z
            x, lengths = padded(list(texts))
            at, first, end = np.arange(x.shape[1])[:, None], np.array(first), np.array(end)
            labelled = (at >= first) & (at < end)
            np.add.at(out[:, :-1], list(rows), (self.positions(x, lengths) * labelled[:, :, None]).sum(0))
            np.add.at(out[:, -1], list(rows), end - first)
        return out


class DocumentLabeller:
    """Pools position probabilities over whole texts; keeps the sums of up to ``room`` distinct words."""

    def __init__(self, net: BiGru | None, langs: list[str], room: int = 150_000):
        import regex

        self.net, self.langs, self.room = net, langs, room
        self.letter, self.map = regex.compile(r"\p{L}"), word_table()
        self.row: dict[bytes, int] = {}
        self.sums = np.zeros((1, len(langs) + 1))
        self.filled = 0

    def _learn(self, new: list[bytes]) -> None:
        if self.filled + len(new) > self.room:
            self.row.clear()
            self.filled = 0
        sums = self.net.word_sums(new)
        need = self.filled + len(new)
        if need > len(self.sums):
            grown = np.zeros((max(need, 2 * len(self.sums)), self.sums.shape[1]))
            grown[: self.filled] = self.sums[: self.filled]
            self.sums = grown
        self.sums[self.filled : need] = sums
        self.row.update(zip(new, range(self.filled, need)))
        self.filled = need

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [t.lower().encode().translate(self.map).split() if t and self.net is not None and self.letter.search(t) else [] for t in texts]
        seen = set().union(*words)
        new = [w for w in seen if w not in self.row]
        if self.filled + len(new) > self.room:
            self.row.clear()
            self.filled = 0
            new = list(seen)
        if new:
            self._learn(new)
        row, langs, scores = self.row, [], []
        for w in words:
            if not w:
                langs.append("und")
                scores.append(0.0)
                continue
            total = self.sums[np.fromiter(map(row.__getitem__, w), np.int64, len(w))].sum(0)
            p = total[:-1] / total[-1]
            best = int(p.argmax())
            langs.append(self.langs[best])
            scores.append(float(min(1.0, p[best])))
        return langs, scores


def training_words(docs: DataFrame, docs_per_lang: int = 1200, words_per_lang: int = 12_000, most_langs: int = 200) -> list[tuple[str, str, int]]:
    """(lang, word, occurrences) of the bounded sample. A language's rows are thinned by their hashes before any sort, so a frequent
    language is not sorted whole."""
    docs = docs.where("lang is not null")
    counts = docs.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(most_langs)
    counts = docs.sparkSession.createDataFrame(counts.collect(), counts.schema)
    hashed = F.xxhash64("doc_id")
    thinned = docs.select("lang", "doc_id").join(F.broadcast(counts), "lang").where(hashed / 2.0**64 + 0.5 <= (2.0 * docs_per_lang + 100) / F.col("rows"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(hashed, "doc_id"))
    ids = thinned.select("lang", "doc_id", first.alias("k")).where(F.col("k") <= docs_per_lang).select("lang", "doc_id").distinct()
    words = docs.join(F.broadcast(ids), ["lang", "doc_id"]).select("lang", F.explode(F.split(F.regexp_replace(F.lower("text"), r"[\x00-\x60\x7b-\x7f]+", " "), " ")).alias("word")).where("word != ''")
    often = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = words.groupBy("lang", "word").agg(F.count("*").alias("n")).withColumn("k", often).where(F.col("k") <= words_per_lang)
    return sorted((r.lang, r.word, r.n) for r in top.collect())


def fit_language_model(docs: DataFrame, **bounds: int) -> tuple[BiGru | None, list[str]]:
    """``docs`` has doc_id, text and lang; rows without a language are not learned from."""
    rows = training_words(docs, **bounds)
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None, []
    words, y, weight = [], [], []
    share = {k: sum(r[2] ** 0.5 for r in rows if r[0] == k) for k in langs}
    for lang, word, n in rows:
        for window, _, _ in word_windows(word.encode()):
            words.append(window)
            y.append(langs.index(lang))
            weight.append(n**0.5 / share[lang])
    return BiGru(len(langs)).fit(words, np.array(y), np.array(weight)), langs


def predict_language(docs: DataFrame, model: tuple[BiGru | None, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row's whole text."""
    net, langs = model
    schema = docs.select(id_col).schema.add("lang_pred", "string").add("score", "double")
    id_type = pa.int64() if docs.schema[id_col].dataType.typeName() == "long" else None

    def run(batches):
        tool = DocumentLabeller(net, langs)
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                names, scores = tool.label(part.column(1).to_pylist())
                ids = part.column(0)
                yield pa.RecordBatch.from_arrays([ids if id_type is None else ids.cast(id_type), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    return in_arrow(docs.select(id_col, text_col), run, schema)


def keep_identified(docs: DataFrame, model: tuple[BiGru | None, list[str]], least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose language is found with a score of ``least`` or more."""
    net, langs = model
    at = docs.columns.index(text_col)

    def run(batches):
        tool = DocumentLabeller(net, langs)
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                names, scores = tool.label(part.column(at).to_pylist())
                yield part.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores)]))

    return in_arrow(docs, run, docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(fold(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang"))
    return predict_language(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
