"""Choosing the next token from a table ``(seq_id, pos, logits array<double>)``.

One row holds one position's scores, so none of this shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from colloquy.functions import scores
from colloquy.functions.hashing import unit_draw


def mask_early_end(logits: DataFrame, eos: int, min_len: int) -> DataFrame:
    """Ban the end token at positions before ``min_len``."""
    return logits.withColumn("logits", scores.ban(
        F.col("logits"), eos, F.col("pos") < min_len))


def select_top_k(logits: DataFrame, top_k: int = 100) -> DataFrame:
    """Replace ``logits`` by ``kept``, the top-k candidates, best first."""
    return logits.withColumn("kept", scores.keep_top_k(
        scores.candidates(F.col("logits")), top_k)).drop("logits")


def select_nucleus(logits: DataFrame, top_p: float = 0.9) -> DataFrame:
    """Replace ``logits`` by ``kept``, the nucleus candidates, best first."""
    return logits.withColumn("kept", scores.keep_nucleus(
        scores.candidates(F.col("logits")), top_p)).drop("logits")


METHODS: dict[str, Callable[..., DataFrame]] = {
    "topk": select_top_k, "nucleus": select_nucleus}


def select(logits: DataFrame, method: str, **options) -> DataFrame:
    """Filter candidates by method name."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {sorted(METHODS)}, got {method!r}")
    return METHODS[method](logits, **options)


def sample(kept: DataFrame, seed: int) -> DataFrame:
    """Renormalise the kept candidates and draw one, repeatably per position."""
    u = unit_draw(F.lit(seed), F.col("seq_id"), F.col("pos"))
    return kept.select("seq_id", "pos", scores.draw(F.col("kept"), u).alias("token_id"))


def candidate_rows(kept: DataFrame) -> DataFrame:
    """One row per kept candidate with its renormalised probability."""
    pairs = F.zip_with("kept", scores.weights(F.col("kept")), lambda c, p: F.struct(
        c["token_id"].alias("token_id"), c["logit"].alias("logit"), p.alias("prob")))
    return kept.select("seq_id", "pos", F.inline(pairs))


def log_softmax_rows(logits: DataFrame) -> DataFrame:
    """One row per token with its log probability."""
    return logits.select("seq_id", "pos", F.posexplode(
        scores.log_softmax(F.col("logits"))).alias("token_id", "log_prob"))


def argmax_tokens(logits: DataFrame) -> DataFrame:
    return logits.select("seq_id", "pos",
                         scores.argmax(F.col("logits")).alias("token_id"))
