"""Chat formatting by prefix-target expansion.

Every assistant turn becomes its own example: all preceding turns as context, then that reply, which alone is
trainable. Turns after the last assistant turn, or a conversation without one, become one more example with
nothing trainable, so that no turn is lost.

Template: ``[INST]`` role ``[/INST]`` text ``</s>`` for each turn. Inside roles and texts a backslash is doubled
and one is put behind the first character of each control string, so no text can make or break a mark; removing
each backslash and keeping what follows it gives the text back.

Defined results: null roles and texts are empty; turns are ordered by turn (null first), then role and text, so
repeated turn numbers have one order; a null conversation id is a conversation; an empty table gives no rows;
other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm.common import in_arrow, read_table

CONTROL = re.compile(r"(<(?=/?s>)|\[(?=/?INST\]))")
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
BATCH_CHARS = 1 << 22


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def examples(turns: Iterable[tuple[str, str]]) -> Iterator[tuple[str, int, int]]:
    """Formatted text of each example and the span of its reply; an empty span if nothing is trainable. One after the other: by the
    method all examples of a conversation are, together, as long as the square of its turns."""
    text, after = "", False
    for role, words in turns:
        text += OPEN + escape(role) + CLOSE
        start = len(text)
        text += escape(words)
        after = role != "assistant"
        if not after:
            yield text + END, start, len(text)
        text += END
    if after:
        yield text, len(text), len(text)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted example."""
    turns = []
    for part in text.split(END)[:-1]:
        role, _, words = part[len(OPEN) :].partition(CLOSE)
        turns.append((unescape(role), unescape(words)))
    return turns


def chat_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start and loss_end (code points), one row for each example."""
    clean = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    schema = conversations.select("conv_id").schema.add("example", "integer").add("text", "string").add("loss_start", "long").add("loss_end", "long")

    def run(batches):
        def batch(b, made):
            columns = list(zip(*made)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (b.schema.field(0).type, pa.int32(), pa.string(), pa.int64(), pa.int64()))], [f.name for f in schema])

        for b in batches:
            made, size = [], 0
            for i in range(b.num_rows):
                key, turns = (b.column(j)[i].as_py() for j in (0, 1))
                for k, e in enumerate(examples((t["role"], t["text"]) for t in turns)):
                    made.append((key, k, *e))
                    size += len(e[0])
                    if size >= BATCH_CHARS:
                        yield batch(b, made)
                        made, size = [], 0
            yield batch(b, made)

    return in_arrow(rows, run, schema)


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: the turns of the longest and the trainable texts of all."""
    schema = made.select("conv_id").schema.add("example", "integer").add("n_turns", "long").add("turns_sha256", "string").add("loss", "string").add("chars", "long")

    def run(batches):
        for b in batches:
            rows = b.to_pydict()
            turns = [parse(t) for t in rows["text"]]
            said = [hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest() for own in turns]
            loss = [unescape(t[a:z]) for t, a, z in zip(rows["text"], rows["loss_start"], rows["loss_end"])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(t) for t in turns], pa.int64()), pa.array(said, pa.string()), pa.array(loss, pa.string()), pa.array([len(t) for t in rows["text"]], pa.int64())], [f.name for f in schema])

    each = in_arrow(made, run, schema)
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    out = each.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max_by("turns_sha256", "n_turns").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(chat_examples(own.unionByName(extra)))
