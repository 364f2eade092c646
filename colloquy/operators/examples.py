"""From turns to (history -> response) training examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from colloquy.config import CorpusConfig, SpecialIds
from colloquy.functions import sequences as S
from colloquy.operators.turns import (
    checked, checked_turn, contexts, is_own, segment_of, with_segments)


def example_index(sizes: DataFrame, config: CorpusConfig) -> DataFrame:
    """One row per example, without any text.

    Takes ``(conv_id, turn, n_ids)``. For each turn from the second on, one
    example per history length 1..max_hist. ``example_len`` counts the whole
    window of ``max_hist`` turns and is the same for all of them;
    ``input_len`` and ``target_len`` are the lengths after truncation. Lengths
    of histories are differences of running sums.
    """
    h = config.max_hist
    order = Window.partitionBy("conv_id", "segment").orderBy("turn")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    window = order.rowsBetween(-h, -1)
    whole, cut = F.col("n_ids") + 1, F.least(F.col("n_ids") + 1, F.lit(config.max_len))
    summed = (with_segments(sizes, h)
              .withColumns({
                  "_whole": F.coalesce(F.sum(whole).over(earlier), F.lit(0)),
                  "_cut": F.coalesce(F.sum(cut).over(earlier), F.lit(0))}))
    rows = (summed
            .select("conv_id", "segment", "turn", "n_ids", "_cut",
                    checked_turn(h).alias("end_idx"),
                    (F.col("_whole") - F.first("_whole").over(window) + whole)
                    .alias("example_len"),
                    F.collect_list("_cut").over(window).alias("_starts"))
            .where(is_own() & (F.col("end_idx") >= 1)))
    target_len = (F.least("n_ids", F.lit(config.max_len)) + 1).cast("bigint")
    return (rows
            .select("*", F.posexplode("_starts").alias("_at", "_start"))
            .select("conv_id", "segment",
                    (F.col("end_idx") - F.size("_starts") + F.col("_at")).alias("begin_idx"),
                    "end_idx", "example_len",
                    (F.col("_cut") - F.col("_start") + 2 + target_len).alias("input_len"),
                    target_len.alias("target_len")))


def running_example_len(sizes: DataFrame, config: CorpusConfig) -> DataFrame:
    """The length key per response turn, as a sliding sum."""
    order = Window.partitionBy("conv_id", "segment").orderBy("turn")
    before = F.sum(F.col("n_ids") + 1).over(order.rowsBetween(-config.max_hist, -1))
    rows = with_segments(sizes, config.max_hist)
    return (rows.withColumn("example_len", before + F.col("n_ids") + 1)
            .withColumn("end_idx", checked_turn(config.max_hist))
            .where(is_own() & (F.col("end_idx") >= 1))
            .select("conv_id", "end_idx",
                    F.col("example_len").cast("bigint").alias("example_len")))


def with_marked_turns(rows: DataFrame, ids: SpecialIds, max_len: int) -> DataFrame:
    """Truncate ``history`` and ``target`` of response turns and add the
    speaker ids and the end token.

    Speakers count back from the response, so this serves every history length.
    """
    return rows.withColumns({
        "history": S.truncated_turns(F.col("history"), ids, max_len),
        "target": S.target_sequence(F.col("target"), ids, max_len)})


def with_sequences(marked: DataFrame, ids: SpecialIds) -> DataFrame:
    """Replace marked ``history`` and ``target`` by ``input_ids``,
    ``token_type_ids`` and ``target_ids``."""
    return (marked
            .withColumn("_prompt", S.input_sequence(F.col("history"), ids))
            .withColumns({
                "input_ids": F.concat("_prompt", "target"),
                "token_type_ids": F.concat(
                    S.token_types(F.col("_prompt"), ids),
                    S.response_types(F.col("target"), ids))})
            .withColumnRenamed("target", "target_ids")
            .drop("_prompt", "history"))


def each_history(rows: DataFrame) -> DataFrame:
    """One row per history length: ``begin_idx`` and ``history`` cut to it."""
    size = F.size("history")
    return cut_history(rows.withColumn("begin_idx", F.explode(F.sequence(
        F.col("end_idx") - size, F.col("end_idx") - 1))))


def cut_history(rows: DataFrame) -> DataFrame:
    """Cut ``history`` to the turns from ``begin_idx`` on."""
    length = (F.col("end_idx") - F.col("begin_idx")).cast("int")
    return rows.withColumn("history", F.slice("history", -length, length))


def build_examples(encoded: DataFrame, ids: SpecialIds,
                   config: CorpusConfig) -> DataFrame:
    """All examples of an encoded, segmented turn table.

    Takes ``(conv_id, segment, turn, n_ids, ids)`` as ``encoded_segments`` makes
    it; one shuffle, on ``(conv_id, segment)``, serves the whole chain.
    """
    rows = contexts(encoded, "ids", config.max_hist, "n_ids")
    length = F.col("history_ids") + F.size("history") + F.col("n_ids") + 1
    marked = with_marked_turns(
        rows.withColumn("example_len", length.cast("bigint")), ids, config.max_len)
    return with_sequences(each_history(marked), ids).select(
        "conv_id", "begin_idx", "end_idx", "example_len",
        "input_ids", "token_type_ids", "target_ids")


def by_segment(index: DataFrame, turns: DataFrame, columns: list[str]) -> DataFrame:
    """Join response turns with the index rows that point at them: one row for each
    index row, with ``columns`` of it.

    ``turns`` stay partitioned by ``(conv_id, segment)``; the index rows of a segment
    come as one row, and each turn picks its own.
    """
    slots = (index.withColumn("segment", segment_of(F.col("end_idx")))
             .groupBy("conv_id", "segment")
             .agg(F.collect_list(F.struct("end_idx", *columns)).alias("_slots")))
    own = F.filter("_slots", lambda slot: slot["end_idx"] == F.col("end_idx"))
    names = [c for c in turns.columns if c != "segment"]
    return (turns.join(slots, ["conv_id", "segment"])
            .select(*names, F.explode(own).alias("_slot"))
            .select(*names, *[F.col("_slot")[c].alias(c) for c in columns]))


def example_lookup(index: DataFrame, encoded: DataFrame, max_hist: int) -> DataFrame:
    """Join index rows with the turns they point at.

    The join is by segment, so the rows of one long conversation spread over many
    tasks and the text is not shuffled again.
    """
    return cut_history(by_segment(index, contexts(encoded, "ids", max_hist), ["begin_idx"]))


def history_band_join(turns: DataFrame, max_hist: int) -> DataFrame:
    """Pairs of a turn and each of the ``max_hist`` turns before it.

    The band is a set of ``max_hist`` fixed distances, so it becomes an
    equality on ``(conv_id, turn)`` that produces no pair to discard.
    """
    turns = checked(turns.select("conv_id", "turn"))
    reach = F.sequence(F.col("turn") + 1, F.col("turn") + max_hist)
    shifted = turns.select("conv_id", F.col("turn").alias("begin_idx"),
                           F.explode(reach).alias("end_idx"))
    ends = turns.select("conv_id", F.col("turn").alias("end_idx"))
    return shifted.join(ends, ["conv_id", "end_idx"]).select(
        "conv_id", "begin_idx", "end_idx")
