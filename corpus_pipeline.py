"""A training corpus in five stages, each over all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm import bpe, exact_dedup, mixing, quality, simhash
from colloquy.session import staged

VOCABULARY = "byte_bpe_50k.json"
# Workers still have what the stages before took, so the tables of the encoder are small.
HELD_PIECES = 60_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules of their own and of their host, of which
    no more than half may fail, whichever rules they fail."""
    return quality.keep_good(docs, joint=True)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the one with the smallest id."""
    return simhash.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; ``intact`` says that they decode to its text."""
    coded = bpe.encode(docs, public_tokenizers.path(VOCABULARY), "doc_id", "source", "text",
                       decoded=True, held=HELD_PIECES)
    return coded.select("doc_id", "source", "ids",
                        F.size("ids").cast("bigint").alias("n_tokens"),
                        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("intact"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

# Fingerprints and merges of symbols have no SQL; the tests compare the rows of
# run() with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is stored as Parquet and
    read again by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
