"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import build_index, search

    vectors = table(spark, sf_dir, "embeddings")
    return search(build_index(vectors), vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=2)


def op3_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import score

    return score(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_chat

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(format_chat(turns.unionByName(more), budget=1024, history=256))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_fm import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"), repetition_limit=1.5)
    return mixed.select("doc_id", "source", F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), F.col("_place").alias("place"), F.col("_weight").alias("source_weight"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_neighbours, op2_packing, op3_hmm_scores, op4_toxicity, op5_quality_rules, op6_simhash, op7_chat, op8_token_counts, op9_quality, op10_mixing)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    from .chat import ORACLE

    return {"op7_chat": ORACLE}
