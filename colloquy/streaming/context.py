"""Rolling conversation context over a stream of turns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from colloquy.config import SEGMENT_TURNS
from colloquy.operators.turns import with_segments

OUTPUT = "conv_id bigint, turn bigint, context array<string>"
STATE = "expected bigint, recent array<string>, turns array<bigint>, texts array<string>"


def _roll(max_hist: int, ttl_ms: int | None):
    """The update function: places a segment's turns in order as they arrive.

    The state holds the number of the next turn, the last ``max_hist`` texts, and
    the turns that are ahead of a gap, at most a segment of them.
    """

    def update(key: tuple, rows: Iterator[pd.DataFrame],
               state: GroupState) -> Iterator[pd.DataFrame]:
        conv_id, segment = key
        first = max(0, segment * SEGMENT_TURNS - (max_hist - 1))
        expected, recent, waiting = first, [], {}
        if state.exists:
            expected, recent, turns, texts = state.get
            recent, waiting = list(recent), dict(zip(turns, texts))
        if state.hasTimedOut:
            if waiting:
                raise ValueError(f"turn {expected} of conversation {conv_id} never came")
            state.remove()
            return
        for part in rows:
            for turn, text in zip(part["turn"], part["text"]):
                if turn < expected or turn in waiting:
                    raise ValueError(f"turn {turn} of conversation {conv_id} came twice")
                waiting[turn] = text
        own, contexts = [], []
        while expected in waiting:
            recent = (recent + [waiting.pop(expected) or ""])[-max_hist:]
            if expected // SEGMENT_TURNS == segment:
                own.append(expected)
                contexts.append(recent)
            expected += 1
        state.update((expected, recent, list(waiting), list(waiting.values())))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"conv_id": [conv_id] * len(own), "turn": own,
                            "context": contexts})

    return update


def stream_context(turns: DataFrame, max_hist: int, ttl_ms: int | None = None) -> DataFrame:
    """For each turn the last ``max_hist`` texts of its conversation.

    Turns may arrive in any order and in any number of micro-batches. A turn is
    put out once all turns before it in its segment have come, with those that
    wait for it; a turn that comes twice fails the job. State is keyed by
    conversation and segment, so it is bounded for each key. Without ``ttl_ms`` it
    is kept for ever; with it, a key that has been idle for so long is forgotten,
    or fails the job if turns still wait for a missing one. Such a stream is one
    that runs on, not one that is drained.
    """
    rows = with_segments(turns.select("conv_id", "turn", "text"), max_hist - 1)
    timeout = (GroupStateTimeout.NoTimeout if ttl_ms is None
               else GroupStateTimeout.ProcessingTimeTimeout)
    return rows.groupBy("conv_id", "segment").applyInPandasWithState(
        _roll(max_hist, ttl_ms), OUTPUT, STATE, "append", timeout)


def check_nothing_waits(spark: SparkSession, state_path: str) -> None:
    """Raise if turns in the state of a drained stream wait for one that did not
    come."""
    state = spark.read.format("statestore").load(state_path)
    value = [f for f in state.schema["value"].dataType.fields if f.name == "groupState"]
    turns = F.col("value.groupState.turns") if value else F.col("value.turns")
    left = state.filter(F.size(turns) > 0).select("key").first()
    if left:
        raise ValueError(f"turns wait for one that did not come: {left['key']}")
