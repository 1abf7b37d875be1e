"""Corpus pipeline: quality, exact and near copies, benchmark leaks, packing. Part of the llm package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relpoint.llm.common import read, store
from relpoint.llm.decontaminate import decontaminate
from relpoint.llm.digest_index import drop_exact
from relpoint.llm.packing import pack_documents, public_tokenizer
from relpoint.llm.quality import keep_good
from relpoint.llm.simhash import drop_near, similar_texts

#: Runs that a packing worker remembers and texts that it splits at once: executors are full from the stages before.
MEMORY, AT_ONCE = 100_000, 250


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of this table, doesn't reject."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays: the one with the largest doc_id."""
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id.

    Fingerprints link at 2 or fewer bits, and texts at a Jaccard similarity of 0.8 or more of their 5-word
    shingles, as near copies mostly differ in more bits. Null and blank texts are one group, repeated rows too.
    """
    return drop_near(docs, similar=similar_texts())


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; those with one go as a whole."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, each with its token ids and its place in a sequence."""
    packed = pack_documents(docs, public_tokenizer(), with_ids=True, memory=MEMORY, at_once=AT_ONCE)
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", leaks),
    ("packing", packing),
]

#: The classifier, the fingerprints and the tokenizer can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each stored before the next one reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
