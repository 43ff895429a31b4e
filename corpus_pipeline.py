"""Documents through the training-data operators, stage by stage.

Each stage gets what its predecessor kept, as written and read again. In all of them a
null text counts as an empty one, columns beyond those of ``documents`` are left out
whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocksmith.llm.decontam import decontaminate
from blocksmith.llm.minhash import near_duplicates
from blocksmith.llm.packing import pack_documents
from blocksmith.llm.shared import Workspace, clear
from blocksmith.llm.suffixes import remove_repeats
from blocksmith.llm.toxicity import drop_toxic, fit_on_labels

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, with all their values.

    Null and empty texts score like one unknown word; rows that repeat a text in one
    language share their fate; a null language has the threshold of all.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs.select(COLUMNS), fit_on_labels(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates; five-word shingles, similarity 0.8.

    Documents without words, with null ids or without near duplicates stay. Rows that
    repeat an id and its text are one document, whose rows all stay or all go.
    """
    kept = near_duplicates(docs, k=5, percent=80).where("kept").select(F.col("doc_id").alias("_id"))
    return docs.select(COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes and more that occur twice; a character that a cut splits goes too.

    All documents stay, some with an empty text; null texts become empty. Rows that repeat
    an id and its text are copies of each other. n_chars is counted anew.
    """
    cut = remove_repeats(docs, length=200, carry=("lang", "source"))
    left = F.col("kept").cast("string")
    text = F.when(F.is_valid_utf8(left), left).otherwise(F.replace(F.make_valid_utf8(left), F.lit("\ufffd"), F.lit("")))
    return cut.select("doc_id", text.alias("text"), "carry.lang", "carry.source").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any eight-word window of a benchmark item, with all their values.

    Rows that repeat an id and its text all stay or all go; documents without words stay.
    """
    return decontaminate(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_items=1)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; null and empty texts are their end id, repeated rows are packed each."""
    return pack_documents(docs, capacity=2048, end=1)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontamination", decontamination), ("packing", packing)]
#: Training and packing can't be put in SQL; tests compare each stage and run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them go when the next stage is written."""
    work = Workspace(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    others = tuple(x for x in Workspace.made if x.spark is spark)  # of queries that may not have been read yet
    for name, stage in STAGES[:-1]:
        docs = work.table(name, stage(spark, docs, sf_dir))
        clear(spark, others)
        if before:
            work.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
