"""The corpus pipeline: language ID, quality classifier, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Each stage gets all that its predecessor kept, written as Parquet and read again. Stages but the last return the columns of their input.

Defined results, in any stage: an empty table gives no rows; extra columns stay, whatever their names. language: null texts and texts
without a letter go, and so do all if no document has a language to learn from. quality: null and empty texts are scored like others;
without labels of both kinds all stay. near_duplicates: of a group the row of least id stays (null ids last), also of rows that share an
id; texts without a word are in no group. decontamination: rows without an id stay; an empty benchmark removes nothing. packing: null and
empty texts are the single id 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm.common import durable, fold, give_back, read_table, scratch
from simloom.llm.decontaminate import decontaminated
from simloom.llm.language_id import fit_language_model, keep_identified
from simloom.llm.ngram_join import one_of_each
from simloom.llm.packing import pack
from simloom.llm.quality import keep_good
from simloom.llm.tokens import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that scores 0.3, go."""
    give_back(spark)
    return keep_identified(docs, fit_language_model(docs.where(fold(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 go."""
    give_back(spark)
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group stays: five-word shingles, similarity of 0.8 or more."""
    give_back(spark)
    return one_of_each(docs, k=5, per_cent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item's five-word shingles go."""
    give_back(spark)
    return decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces of up to 2048 tokens, with their sequence and place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    give_back(spark)
    return pack(docs, tokenizer_path())


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: SQL cannot express the classifiers and the tokenizer; tests hold each stage, and the whole run, against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes on its way goes when its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            docs = durable(out, keep=True)
    return docs
