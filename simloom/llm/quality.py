"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each whole text becomes a vector of statistics (sizes, character classes, repetition of words, word
triples and lines, compressibility); shares go through an arcsine, sizes through a logarithm. Each class
has a mean and a covariance shrunk towards the pooled covariance and towards its own mean variance. Their
Cholesky factors are computed once, and a score is a logistic of the difference of the Mahalanobis
log-densities, divided by ``temperature``.

The moments are exact sums over all labelled rows; nothing is sampled. Statistics are written once to the
shared folder, so that fitting and scoring read each text once.

Defined results: null and empty texts have the statistics of an empty string and are scored like others;
rows with a null label or id are not learned from; repeated documents are scored alike, repeated labels
count as often as they occur; with fewer than two labelled rows of either class every score is 0.5; an
empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.llm.common import durable, fold, in_arrow, read_table

CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!", b"#$%&*@~^", b"|", b",.;:", b"<>{}[]()=_/\\", b"\n", b" \t\r"]


def char_classes() -> np.ndarray:
    member = np.zeros((len(CLASSES), 256))
    for i, chars in enumerate(CLASSES):
        member[i, list(chars)] = 1
    return member


def statistics(text: str | None, member: np.ndarray) -> list[float]:
    raw = (text or "").encode()
    n = len(raw)
    share = member @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / max(n, 1)
    words = raw.lower().split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = len(words)
    times = Counter(words)
    triples = len(set(zip(words, words[1:], words[2:])))
    caps = sum(map(bytes.isupper, raw.split())) if share[0] > 0.02 else 0
    fractions = [*share, 1 - share.sum(), len(times) / max(m, 1), max(times.values(), default=0) / max(m, 1), triples / max(m - 2, 1), len(set(lines)) / max(len(lines), 1), caps / max(m, 1)]
    sizes = [n, m, n / max(m, 1), len(lines), m / max(len(lines), 1), max(map(len, times), default=0)]
    packed = len(zlib.compress(raw, 1)) / (n + 12)
    return [*np.arcsin(np.sqrt(np.clip(fractions, 0, 1))), *np.log1p(sizes), packed]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``stats`` array<double> of every row's whole text."""
    schema = docs.select(id_col).schema.add("stats", T.ArrayType(T.DoubleType()))

    def run(batches):
        member = char_classes()
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                rows = [statistics(t, member) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], [id_col, "stats"])

    return in_arrow(docs.select(id_col, text_col), run, schema)


def class_moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of ``stats`` by ``label``: a partial sum for each partition, sums of 64 groups of those, then
    one row a class."""

    def partial(parts):
        sums: dict[int, list] = {}
        for pdf in parts:
            for label, own in pdf.groupby("label"):
                x = np.stack(own["stats"].to_numpy())
                old = sums.setdefault(int(label), [0.0, np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)])
                old[0] += len(x)
                old[1] += x.sum(0)
                old[2] += x.T @ x
        yield pd.DataFrame([(k, TaskContext.get().partitionId() % 64, n, s, ss.ravel()) for k, (n, s, ss) in sums.items()], columns=["label", "part", "n", "s", "ss"])

    def total(pdf):
        return pd.DataFrame([(pdf["label"].iloc[0], pdf["part"].iloc[0], pdf["n"].sum(), np.sum(np.stack(pdf["s"]), axis=0), np.sum(np.stack(pdf["ss"]), axis=0))], columns=["label", "part", "n", "s", "ss"])

    schema = "label int, part int, n double, s array<double>, ss array<double>"
    parts = rows.select("label", "stats").mapInPandas(partial, schema).groupBy("label", "part").applyInPandas(total, schema)
    got = parts.groupBy("label").applyInPandas(total, schema).collect()
    return {r.label: (r.n, np.array(r.s), np.array(r.ss).reshape(len(r.s), -1)) for r in got}


class Discriminant:
    """Two-class quadratic discriminant with shrunken covariances and cached Cholesky factors."""

    def __init__(self, moments: dict, to_pooled: float = 0.1, to_identity: float = 0.02, temperature: float = 4.0):
        self.temperature = temperature
        self.ready = all(k in moments and moments[k][0] >= 2 for k in (0, 1))
        if not self.ready:
            return
        n = {k: moments[k][0] for k in (0, 1)}
        mean = {k: moments[k][1] / n[k] for k in (0, 1)}
        cov = {k: moments[k][2] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)}
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        self.shift = (n[0] * mean[0] + n[1] * mean[1]) / (n[0] + n[1])
        both = np.outer(self.scale, self.scale)
        self.parts = {}
        for k in (0, 1):
            c = (1 - to_pooled) * cov[k] / both + to_pooled * pooled / both
            c = (1 - to_identity) * c + to_identity * max(np.trace(c) / len(c), 1e-3) * np.eye(len(c))
            low = np.linalg.cholesky(c)
            self.parts[k] = ((mean[k] - self.shift) / self.scale, np.linalg.inv(low), -np.log(np.diag(low)).sum() + np.log(n[k] / (n[0] + n[1])))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), 0.5)
        z = (x - self.shift) / self.scale
        density = {k: add - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) for k, (mean, inverse, add) in self.parts.items()}
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / self.temperature, -700, 700)))


def fitted(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str, **shrinkage: float) -> Discriminant:
    learn = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (fold(F.col(id_col), 5) != 0))
    # Written out, so that no task holds a worker for statistics and another for moments.
    return Discriminant(class_moments(durable(learn.join(stats, id_col).select("label", "stats"))), **shrinkage)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all columns, that score ``threshold`` or more. Only statistics of labelled rows are moved."""
    model = fitted(document_statistics(docs, id_col, text_col), labels, id_col, label_col)
    at = docs.columns.index(text_col)

    def run(batches):
        member = char_classes()
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                x = np.array([statistics(t, member) for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(model.scores(x) >= threshold))

    return in_arrow(docs, run, docs.schema)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, **shrinkage: float) -> DataFrame:
    """id, held_out, score and predicted of every row; labels are learned from rows of folds 1 to 4 only."""
    stats = durable(document_statistics(docs, id_col, text_col))
    model = fitted(stats, labels, id_col, label_col, **shrinkage)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    out = stats.select(id_col, (fold(F.col(id_col), 5) == 0).alias("held_out"), score("stats").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
