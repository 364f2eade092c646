"""Padded batches: every example padded to the size of its batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colloquy.config import CorpusConfig, SpecialIds
from colloquy.functions import padding as P
from colloquy.operators.batching import BATCH
from colloquy.operators.examples import (
    by_segment, cut_history, with_marked_turns, with_sequences)
from colloquy.operators.turns import contexts

KEYS = ["conv_id", "begin_idx", "end_idx"]


def batch_rows(plan: DataFrame, encoded: DataFrame, ids: SpecialIds,
               config: CorpusConfig) -> DataFrame:
    """Join the batch plan with the encoded turns and build the sequences.

    The plan's rows of a segment, a few numbers each and at most ``max_hist`` per
    turn, travel as one row to the segment's turns, which are where the encoding
    has put them: the text is not shuffled again.
    """
    slot = ["begin_idx", *BATCH, "draw", "max_seq", "max_target",
            "input_len", "target_len"]
    turns = with_marked_turns(contexts(encoded, "ids", config.max_hist), ids, config.max_len)
    rows = by_segment(plan, turns, slot).select(
        "conv_id", "end_idx", "begin_idx", "history", "target", *slot[1:])
    return with_sequences(cut_history(rows), ids)


def collate_causal(rows: DataFrame, pad: int) -> DataFrame:
    """Left-to-right training batch: inputs without their last position and
    labels without their first."""
    size = F.col("max_seq")
    return rows.select(
        *KEYS, *BATCH,
        P.drop_last(P.pad_to(F.col("input_ids"), size, pad)).alias("input_ids"),
        P.drop_last(P.pad_to(F.col("token_type_ids"), size, pad)).alias("token_type_ids"),
        P.drop_first(P.next_token_labels(
            F.col("input_ids"), F.col("target_ids"), size, pad)).alias("labels"))


def collate_causal_eval(rows: DataFrame, pad: int) -> DataFrame:
    """Left-to-right inference batch: padding only."""
    size = F.col("max_seq")
    return rows.select(
        *KEYS, *BATCH,
        P.pad_to(F.col("input_ids"), size, pad).alias("input_ids"),
        P.pad_to(F.col("token_type_ids"), size, pad).alias("token_type_ids"))


def collate_permuted(rows: DataFrame, pad: int) -> DataFrame:
    """Permutation-language training batch without its masks."""
    size = F.col("max_seq")
    return rows.select(
        *KEYS, *BATCH, "max_seq", "max_target", "input_len", "target_len",
        P.pad_to(F.col("input_ids"), size, pad).alias("input_ids"),
        P.pad_to(F.col("token_type_ids"), size, pad).alias("token_type_ids"),
        P.pad_to(F.col("target_ids"), F.col("max_target"), pad).alias("labels"),
        P.attention(F.col("input_len"), size).alias("attention_mask"))


def collate_permuted_eval(rows: DataFrame, pad: int) -> DataFrame:
    """Permutation-language inference batch without its masks."""
    size = F.col("max_seq")
    return rows.select(
        *KEYS, *BATCH, "max_seq", "input_len",
        P.pad_to(F.col("input_ids"), size, pad).alias("input_ids"),
        P.pad_to(F.col("token_type_ids"), size, pad).alias("token_type_ids"),
        P.attention(F.col("input_len"), size).alias("attention_mask"))


def with_train_masks(rows: DataFrame) -> DataFrame:
    """Add ``perm_mask`` and ``target_map``, quadratic in the batch's length;
    needs the lengths only, so compute it where it is consumed."""
    prompt = F.col("input_len") - F.col("target_len")
    return (rows
            .withColumn("perm_mask", P.permutation_mask(
                prompt, F.col("input_len"), F.col("max_seq")))
            .withColumn("target_map", P.target_map(
                prompt, F.col("input_len"), F.col("max_target"), F.col("max_seq"))))


def with_eval_masks(rows: DataFrame) -> DataFrame:
    """The same for inference, where the last slot is predicted."""
    return (rows
            .withColumn("perm_mask", P.next_slot_mask(
                F.col("input_len"), F.col("max_seq")))
            .withColumn("target_map", P.next_slot_map(
                F.col("input_len"), F.col("max_seq"))))


# The pad id that each layout's usual vocabulary has.
PAD_IDS = {"causal": 50261, "permuted": 5}

TRAIN_LAYOUTS = {"causal": collate_causal, "permuted": collate_permuted}
EVAL_LAYOUTS = {"causal": collate_causal_eval, "permuted": collate_permuted_eval}


def collate(rows: DataFrame, layout: str, pad: int | None = None,
            training: bool = True) -> DataFrame:
    """Collate by layout name."""
    layouts = TRAIN_LAYOUTS if training else EVAL_LAYOUTS
    if layout not in layouts:
        raise ValueError(f"layout must be one of {sorted(layouts)}, got {layout!r}")
    return layouts[layout](rows, PAD_IDS[layout] if pad is None else pad)
