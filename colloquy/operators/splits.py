"""Splits, manifests, and merging and auditing of dialogue sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.config import SPLITS, CorpusConfig
from colloquy.functions.hashing import config_fingerprint
from colloquy.operators.turns import checked, segment_of, with_split


def split_manifest(turns: DataFrame, config: CorpusConfig) -> DataFrame:
    """Counts per split. A turn at position t ends min(t, max_hist) examples, so
    a partial aggregation over single rows gives all counts, once the numbering
    is checked."""
    rows = checked(with_split(turns).select("split", "conv_id", "turn"))
    counted = rows.groupBy("split").agg(
        F.count_if(F.col("turn") == 0).alias("n_dialogs"),
        F.sum(F.least(F.col("turn"), F.lit(config.max_hist)))
        .cast("bigint").alias("n_examples"))
    return (counted
            .withColumn("max_hist", F.lit(config.max_hist))
            .withColumn("fingerprint", config_fingerprint(
                F.lit(config.max_hist), F.lit(config.file_size))))


def merge_precedence(low: DataFrame, high: DataFrame) -> DataFrame:
    """Union of two turn tables; where both hold a conversation, ``high`` wins.

    Keys are compared per ``(conv_id, segment)``, so that the rows of one long
    conversation are not sent to one task.
    """
    keys = ["conv_id", "segment"]
    rows = low.withColumn("segment", segment_of(F.col("turn")))
    taken = (rows.select(*keys).distinct()
             .join(high.select("conv_id").distinct(), "conv_id", "left_semi"))
    return (rows.join(taken, keys, "left_anti")
            .select(*low.columns).unionByName(high))


def dialog_digest(turns: DataFrame) -> DataFrame:
    """An order-aware content digest per conversation from mergeable sums; a
    ``split`` of the source's own is kept."""
    digest = F.md5(F.concat_ws(":", F.col("turn").cast("string"), F.col("text")))
    piece = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint")
             for i in range(4)]
    sums = [F.sum(p.cast("decimal(38,0)")).cast("string") for p in piece]
    split = [F.first("split").alias("split")] if "split" in turns.columns else []
    return (turns.groupBy("conv_id")
            .agg(*split, F.concat_ws("-", F.count(F.lit(1)).cast("string"), *sums).alias("digest")))


def split_overlap(items: DataFrame, key: Column) -> DataFrame:
    """How many distinct items of each split also occur in another split.

    Copies are counted down to one row per item first, so that an item that
    fills the corpus weighs no more than any other.
    """
    seen = items.groupBy(key.alias("_key")).agg(*[
        F.max(F.when(F.col("split") == s, 1).otherwise(0)).alias(s) for s in SPLITS])
    total = sum((F.col(s) for s in SPLITS[1:]), F.col(SPLITS[0]))
    counts = [F.struct(F.lit(s).alias("split"), F.col(s).alias("has"),
                       (F.col(s) * F.when(total > 1, 1).otherwise(0)).alias("shared"))
              for s in SPLITS]
    return (seen.select(F.inline(F.array(*counts)))
            .groupBy("split")
            .agg(F.sum("has").cast("bigint").alias("n_items"),
                 F.sum("shared").cast("bigint").alias("n_shared")))
