"""From raw documents to packed training sequences: five operators, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm.common import durable
from rasterloom.llm.entries import table, vocabulary
from rasterloom.llm.mixing import mixed_in_order
from rasterloom.llm.packing import pack
from rasterloom.llm.quality_rules import keep_good
from rasterloom.llm.similar_texts import keep_one
from rasterloom.llm.toxicity import remove_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the model learns from the labels of documents that are here."""
    return remove_toxic(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the fixed rule nor a learned fence rejects."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: similarity 0.8 or more over five-word shingles."""
    return keep_one(docs, words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every use of a document under tempered source weights, in the order of the blocks; none is dropped."""
    return mixed_in_order(docs, repetition_limit=1.5)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return pack(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=2)


STAGES = [("toxicity", toxicity), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Models, hashes and a tokenizer decide what stays; SQL cannot express a stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
