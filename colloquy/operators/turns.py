"""Turn tables: ``(conv_id, turn, ...)`` with one row per utterance.

``turn`` counts 0, 1, 2, ... within a conversation. Work that looks at
neighbouring turns is keyed by ``(conv_id, segment)``, a run of
``SEGMENT_TURNS`` turns, with the few turns before each segment copied into
it. So a conversation of any length spreads over many tasks, and no conversation
is ever gathered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.config import SEGMENT_TURNS
from colloquy.functions.numbers import whole_part
from colloquy.operators.ranking import BLOCK, counted_out, total_before


def split_of(conv_id: Column) -> Column:
    """Eight tenths train, one tenth valid, one tenth test, by id."""
    digit = F.pmod(conv_id, F.lit(10))
    return (F.when(digit < 8, "train").when(digit == 8, "valid").otherwise("test"))


def with_split(turns: DataFrame) -> DataFrame:
    """Keep the source's own ``split`` column, or derive one from the id."""
    if "split" in turns.columns:
        return turns
    return turns.withColumn("split", split_of(F.col("conv_id")))


def segment_of(turn: Column) -> Column:
    return whole_part(turn, SEGMENT_TURNS)


def renumbered(turns: DataFrame) -> DataFrame:
    """Replace ``turn`` by the dense 0-based position within the conversation.

    For inputs whose turn numbers have gaps. Rows are numbered within pieces of
    the conversation; the pieces' sizes, one small row each, give the offsets.
    """
    keys = ["conv_id", "_piece"]
    pieces = turns.withColumn("_piece", segment_of(F.col("turn")))
    counts = (pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_block", whole_part(F.col("_piece"), BLOCK)))
    offsets = total_before(counts, ["conv_id"], ["_block"], [F.col("_piece")],
                           "_offset", weight="_n").select(*keys, "_offset")
    own = Window.partitionBy(*keys).orderBy("turn")
    return (pieces.withColumn("_row", F.row_number().over(own).cast("bigint") - 1)
            .join(offsets, keys)
            .withColumn("turn", F.col("_offset") + F.col("_row"))
            .drop("_piece", "_offset", "_row"))


def per_segment(dialogs: DataFrame) -> DataFrame:
    """Repeat conversation rows for each ``segment`` of their ``n_turns`` turns,
    to join them with turns on ``(conv_id, segment)``."""
    return counted_out(dialogs, segment_of(F.col("n_turns") - 1), "segment")


def with_segments(turns: DataFrame, reach: int) -> DataFrame:
    """Add ``segment``; a turn also goes to each later segment that starts
    within ``reach`` turns after it."""
    first = segment_of(F.col("turn"))
    last = segment_of(F.col("turn") + F.lit(reach))
    return turns.withColumn("segment", F.explode(F.sequence(first, last)))


def is_own() -> Column:
    """Whether a row lies in its segment, rather than being copied before it."""
    return F.col("segment") == segment_of(F.col("turn"))


def checked_turn(reach: int) -> Column:
    """``turn``, failing the job where the numbering has a gap or a repeat."""
    order = Window.partitionBy("conv_id", "segment").orderBy("turn")
    before = F.lag("turn").over(order)
    start = F.greatest(F.lit(0), F.col("segment") * SEGMENT_TURNS - reach)
    expected = F.coalesce(before + 1, start)
    return F.when(F.col("turn") == expected, F.col("turn")).otherwise(
        F.raise_error(F.concat(
            F.lit("turns not numbered 0, 1, 2, ... in conversation "),
            F.col("conv_id").cast("string"), F.lit("; use renumbered()"))))


def checked(turns: DataFrame) -> DataFrame:
    """``turns`` with ``segment``, failing the job where the numbering has a gap, a
    repeat or a late start. Each segment sees the last turn before it."""
    others = [c for c in turns.columns if c != "turn"]
    return (with_segments(turns, 1)
            .select(*others, "segment", checked_turn(1).alias("turn"))
            .where(F.col("segment") == segment_of(F.col("turn")))
            .select(*turns.columns, "segment"))


def contexts(segmented: DataFrame, value: str, max_hist: int,
             *keep: str) -> DataFrame:
    """Each turn but the first with the up to ``max_hist`` turns before it.

    Takes the output of :func:`with_segments` for a reach of ``max_hist``.
    Returns ``(conv_id, segment, end_idx, history, target)`` where ``history``
    is an array of ``value`` and ``target`` the turn's own value, and the
    columns named in ``keep``. With ``n_ids`` among those, ``history_ids`` is
    its sum over the history.
    """
    before = Window.partitionBy("conv_id", "segment").orderBy("turn").rowsBetween(
        -max_hist, -1)
    total = [F.sum("n_ids").over(before).alias("history_ids")] if "n_ids" in keep else []
    return (segmented
            .select("conv_id", "segment", "turn", *keep, *total,
                    checked_turn(max_hist).alias("end_idx"),
                    F.collect_list(value).over(before).alias("history"),
                    F.col(value).alias("target"))
            .where(is_own() & (F.col("end_idx") >= 1))
            .drop("turn"))


def rolling_context(turns: DataFrame, max_hist: int) -> DataFrame:
    """For each turn the texts of the last ``max_hist`` turns, itself included."""
    order = Window.partitionBy("conv_id", "segment").orderBy("turn")
    frame = order.rowsBetween(-(max_hist - 1), 0)
    rows = with_segments(turns, max_hist - 1)
    return (rows
            .select("conv_id", "segment", "turn",
                    checked_turn(max_hist - 1).alias("position"),
                    F.collect_list(F.coalesce("text", F.lit(""))).over(frame)
                    .alias("context"))
            .where(is_own() & (F.col("position") >= 0))
            .select("conv_id", F.col("position").alias("turn"), "context"))


def assembled(turns: DataFrame, *more: Column) -> DataFrame:
    """Ordered utterance lists of pieces of conversations: ``conv_id, segment``, the
    piece's ``first_turn``, ``utterances``, and the aggregates ``more``.

    A conversation is one piece unless it is longer than a segment.
    """
    ordered = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return (turns.withColumn("segment", segment_of(F.col("turn")))
            .groupBy("conv_id", "segment")
            .agg(ordered["text"].alias("utterances"),
                 F.min("turn").cast("bigint").alias("first_turn"), *more))


def dialog_sizes(turns: DataFrame) -> DataFrame:
    """``(split, conv_id, n_turns)``; partial counts, nothing is gathered."""
    return with_split(turns).groupBy("split", "conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"))


def eligible(turns: DataFrame) -> DataFrame:
    """Conversations with at least two turns; only they yield examples."""
    return dialog_sizes(turns).where("n_turns >= 2")


def examples_before(end: Column, max_hist: int) -> Column:
    """How many examples of a conversation end before turn ``end`` (>= 1)."""
    short = F.least(end - 1, F.lit(max_hist)).cast("bigint")
    return (whole_part(short * (short + 1), 2)
            + (end - 1 - short) * F.lit(max_hist)).cast("bigint")


def examples_of(n_turns: Column, max_hist: int) -> Column:
    """How many examples a conversation of ``n_turns`` turns yields."""
    return examples_before(n_turns, max_hist)
