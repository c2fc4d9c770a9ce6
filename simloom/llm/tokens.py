"""Exact token ids of whole texts, chunk by chunk, and the exact length histogram.

The tokenizer's pre-tokenizer always splits at ASCII white space and drops it, and its normalizer does not
look across it, so a text's ids are those of its white-space-separated chunks in order. Each distinct chunk is
encoded by the tokenizer once in a task (up to ``room`` chunks are kept) and its ids are kept as bytes.

Histogram: documents are counted by encoded length, first within each partition, and suffix sums over the
distinct lengths answer every context limit: documents that exceed it and tokens that remain after truncation.

Defined results: null and empty texts have length 0; repeated rows count each; an empty table gives no rows;
other columns are never read.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simloom.llm.common import in_arrow, read_table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A run of marks between a letter (of ASCII or Latin-1) and white space: the tokenizer keeps such runs together and apart from the letter.
STOP = re.compile(rb"([.,!?;:#$%&*](?:(?<=[A-Za-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[.,!?;:#$%&*]*)(?=\s)", re.S)


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes. Only for tokenizers that lower-case and drop ASCII white space.

    ASCII capitals are lower-cased, and marks between a letter and white space are set apart, before chunks are
    looked up: the tokenizer does both too, and there are fewer distinct chunks. Texts with ``<|`` are left as they are,
    for a special token is recognised before. New chunks that are one Latin word go to the tokenizer's merges at once, in lower case and
    many words in a call (each word's last token bears the word-end suffix); all others go through the whole tokenizer. Of ``room`` chunks
    that are kept, those that came again stay when it is full.
    """

    def __init__(self, path: str, room: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tool, self.room, self.known, self.again = Tokenizer.from_file(path), room, {}, set()
        self.words = None
        suffix = getattr(self.tool.model, "end_of_word_suffix", None)
        if suffix:
            self.words = Tokenizer(self.tool.model)
            self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.last = np.zeros(self.tool.get_vocab_size(), bool)
            self.last[[i for t, i in self.tool.get_vocab().items() if t.endswith(suffix)]] = True
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabets keep these and move the others up
            hidden = [b for b in range(256) if b not in set(shown)]
            self.alphabet = {b: 256 + i for i, b in enumerate(hidden) if b != 32}

    def _learn(self, chunks: list[bytes]) -> None:
        words, rest, shown = [], [], []
        for c in sorted(chunks, key=bytes.isascii):
            if self.words is not None and c.isascii() and c.isalpha() and c.islower():
                words.append(c)
                shown.append(c)
            elif self.words is not None and not c.isascii() and (t := c.decode()).isalpha() and (t := t.lower()).isalpha() and max(t) < "\u02b0":
                words.append(c)
                shown.append(t.encode())
            else:
                rest.append(c)
        joined = [b" ".join(shown[a : a + 512]).decode("latin-1") for a in range(0, len(shown), 512)]
        joined = [t if t.isascii() else t.translate(self.alphabet) for t in joined]
        ids = np.array([i for e in self.words.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], "<u4") if words else np.zeros(0, "<u4")
        raw, ends = ids.tobytes(), ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist() if words else []
        self.known.update(zip(words, [raw[i:j] for i, j in zip([0, *ends], ends)], strict=True))
        for a in range(0, len(rest), 8192):
            part = rest[a : a + 8192]
            for c, e in zip(part, self.tool.encode_batch_fast([c.decode() for c in part], add_special_tokens=False)):
                self.known[c] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        raw = [(t or "").encode() for t in texts]
        chunks = [t.split() if b"<|" in t else STOP.sub(rb" \1", t.lower()).split() for t in raw]
        seen = set().union(*chunks)
        new = {c for c in seen if c not in self.known}
        self.again |= seen - new
        if len(self.known) + len(new) > self.room:
            self.known = {c: self.known[c] for c in self.again}
            if len(self.known) + len(new) > self.room:
                self.known = {c: self.known[c] for c in seen - new}
            self.again = set()
        self._learn(list(new))
        known = self.known
        return [b"".join(itemgetter(*c)(known)) if len(c) > 1 else b"".join(known[x] for x in c) for c in chunks]


def token_lengths(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """n_tokens and n_docs, one row for each length and partition."""

    def run(batches):
        tool, counts = ChunkEncoder(path), Counter()
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                counts.update(len(x) // 4 for x in tool.encode(b.slice(a, 1024).column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["n_tokens", "n_docs"])

    return in_arrow(docs.select(text_col), run, "n_tokens long, n_docs long")


def length_histogram(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """One row for each length that occurs, with suffix sums: ``docs_longer`` and ``tokens_within`` answer a limit of that length,
    ``docs_upto`` and ``share_upto`` a quantile, ``total_tokens`` and ``total_docs`` the whole corpus."""
    counts = token_lengths(docs, path, text_col).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    longer = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.col("n_tokens") * F.col("n_docs")
    out = counts.select("n_tokens", "n_docs", F.coalesce(F.sum("n_docs").over(longer), F.lit(0)).alias("docs_longer"), F.coalesce(F.sum(tokens).over(longer), F.lit(0)).alias("tokens_longer"))
    whole = Window.partitionBy()
    out = out.withColumns({"total_docs": F.sum("n_docs").over(whole), "total_tokens": F.sum(tokens).over(whole)})
    out = out.withColumn("docs_upto", F.col("total_docs") - F.col("docs_longer"))
    out = out.withColumn("tokens_within", F.col("total_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens"))
    return out.withColumn("share_upto", F.col("docs_upto") / F.col("total_docs"))


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens that remain when every document is cut to ``limit``."""
    row = histogram.agg(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs"))).first()
    return int(row[0] or 0)


def length_quantile(histogram: DataFrame, q: float) -> int | None:
    """The least length that at least a share ``q`` of the documents do not exceed."""
    row = histogram.where(F.col("docs_upto") >= F.lit(q) * F.col("total_docs")).agg(F.min("n_tokens")).first()
    return row[0]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(read_table(spark, sf_dir, "documents"), tokenizer_path())
