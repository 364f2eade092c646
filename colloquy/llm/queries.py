"""Registered queries of this subpackage and the SQL of those that have one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm import (bpe, chat_format, collocations, exact_dedup, language, lm_scoring,
                          mixing, prefix_trie, quality as quality_rules, simhash, substring_dedup,
                          token_counts, toxicity)
from colloquy.llm.common import documents, text_digest


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return toxicity.toxicity(documents(spark, sf_dir),
                             spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language.identify(documents(spark, sf_dir))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a part of the repaired and rendered conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return chat_format.repaired(turns).drop("place")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by weights 5, 2, 1 takes of every document."""
    return mixing.mixture(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.duplicates(documents(spark, sf_dir), keep="largest").select(
        "doc_id", "keep_id", "group_size", "kept",
        F.substring("digest", 1, 64).alias("text_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that an earlier one has in a passage."""
    return substring_dedup.substring_dedup(documents(spark, sf_dir))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode(documents(spark, sf_dir), path, "doc_id", decoded=True)
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
        .alias("ids_sha256"),
        text_digest(F.col("decoded")).alias("decoded_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of every document, in the section where they begin."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.section_tokens(documents(spark, sf_dir), path, "doc_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality_rules.quality(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    return collocations.collocations(documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document."""
    return lm_scoring.lm_scores(documents(spark, sf_dir))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_language": op3_language,
    "op4_chat_format": op4_chat_format,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_bpe": op8_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
    "op11_collocations": op11_collocations,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_lm_scoring": op13_lm_scoring,
}
