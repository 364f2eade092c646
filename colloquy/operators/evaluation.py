"""Text-level evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.config import SP1, SP2, CorpusConfig
from colloquy.functions.text import prompt_of, reply_of, words
from colloquy.operators.examples import each_history
from colloquy.operators.turns import (
    checked, contexts, dialog_sizes, per_segment, with_segments, with_split)

EXAMPLE = ["conv_id", "begin_idx", "end_idx"]


def rendered_examples(turns: DataFrame, config: CorpusConfig) -> DataFrame:
    """Each example as one line of text with speaker marks, cut to
    ``max_len`` words per turn, the mark of a history turn included."""
    rows = with_split(turns).select("split", "conv_id", "turn", F.slice(
        words(F.col("text")), 1, config.max_len).alias("words"))
    pairs = each_history(contexts(
        with_segments(rows, config.max_hist), "words", config.max_hist, "split"))
    count = F.size("history")

    def mark(turn: Column, i: Column) -> Column:
        role = F.when(F.pmod(count - 1 - i, F.lit(2)) == 0, SP2).otherwise(SP1)
        return F.concat_ws(" ", role, F.array_join(
            F.slice(turn, 1, config.max_len - 1), " "))

    line = F.concat_ws(" ", F.array_join(F.transform("history", mark), " "),
                       F.lit(SP1), F.array_join("target", " "))
    return pairs.select(*EXAMPLE, "split", line.alias("rendered"))


def normalized_examples(rendered: DataFrame) -> DataFrame:
    """Split a rendered line into prompt and reply without speaker marks."""
    line = F.col("rendered")
    return rendered.select(*EXAMPLE, "split", prompt_of(line).alias("input"),
                           reply_of(line).alias("target"))


def align(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Pair each example with the response predicted for it."""
    return examples.join(predictions, EXAMPLE)


def eval_table(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Lowercased inputs, targets and responses, one row per example."""
    return align(examples, predictions).select(
        *EXAMPLE, F.lower("input").alias("input"), F.lower("target").alias("target"),
        F.lower("response").alias("response"))


def word_vocab(turns: DataFrame, config: CorpusConfig) -> DataFrame:
    """Distinct lowercase words of the training prompts and of the test prompts
    and replies.

    Read off the turns: each turn but a conversation's last is shown as
    history, with one word less than a reply keeps; each but the first is a
    reply. The examples, which repeat turns, are not built.
    """
    rows = checked(turns.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.slice(words(F.col("text")), 1, config.max_len).alias("words")))
    sizes = per_segment(dialog_sizes(turns))
    split = F.col("split")
    shown = (F.col("turn") < F.col("n_turns") - 1) & split.isin("train", "test")
    replied = (F.col("turn") > 0) & (split == "test")
    room = (F.when(replied, config.max_len)
            .when(shown, config.max_len - 1).otherwise(0))
    return (rows.join(sizes, ["conv_id", "segment"])
            .select(F.explode(F.slice("words", F.lit(1), room)).alias("word"))
            .select(F.lower("word").alias("word")).distinct())


def response_scores(table: DataFrame) -> DataFrame:
    """Length and distinct-1/2 shares of each response."""
    w = F.col("_w")
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))),
                       F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))),
                       lambda a, b: F.concat_ws(" ", a, b))
    share = lambda items: F.try_divide(
        F.size(F.array_distinct(items)), F.size(items))
    return (table.withColumn("_w", words(F.col("response")))
            .withColumn("_p", pairs)
            .select(*EXAMPLE, F.size("_w").alias("length"),
                    share(w).alias("distinct_1"),
                    share(F.col("_p")).alias("distinct_2")))
