"""Chat formatting by role repair of minimum cost.

A legal conversation is an optional system turn, then user and assistant in turn, ending
with the assistant. Each given turn is put into a turn of some role: it begins the next
legal turn, it is merged into the one before, or an empty turn is inserted so
that it becomes legal; its role may be relabelled. A dynamic program over the states
of the automaton finds the cheapest sequence of these, which is then rendered.

Rows are put in order once, by conversation and turn, cut into ranges of like size;
a conversation of any length thus spreads over as many ranges as it needs. Costs
from state to state combine like products of matrices: for the conversations that cross
a border (one at each border at most) every range gives one small matrix, and the
costs and states at its borders follow from those. Each range is then repaired by itself.
Of equal costs, going back from the end, the first role in the order system, user,
assistant is taken, so the result does not depend on the borders.

Rendering gives one fragment per row, in the order of ``place``; a conversation's
text is its fragments one after another. Fragments are not gathered, since a
conversation, or one of its merged turns, may be larger than a task can hold.

Cases: a null text counts as empty; a null or unknown role is relabelled at ``UNKNOWN``;
rows without ``conv_id`` are one conversation; null turns come first, equal turns in
the order of role and text; repeated rows are turns of their own; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import small_side
from colloquy.operators.ranking import range_placed
from colloquy.session import staged

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = (None, *ROLES)
# What may follow what.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, UNKNOWN, INSERT = 1, 2, 1, 3
FAR = 1 << 40
# Empty turns that end a conversation legally.
ENDING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
FINAL = np.array([INSERT * len(ENDING[s]) for s in range(4)], np.int64)

OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"


def _moves() -> tuple[np.ndarray, dict]:
    """By role given (0 unknown), the costs from state to state, and how each of
    these moves is made: ``merge``, ``turn`` or the role of an inserted turn."""
    costs = np.full((4, 4, 4), FAR, np.int64)
    how = {}
    for given in range(4):
        for state in range(4):
            for role in (SYSTEM, USER, ASSISTANT):
                label = 0 if role == given else UNKNOWN if given == 0 else RELABEL
                ways = []
                if role in NEXT[state]:
                    ways.append((label, 0, "turn"))
                if role == state:
                    ways.append((label + MERGE, 1, "merge"))
                ways += [(label + INSERT, 2, between) for between in NEXT[state]
                         if role in NEXT[between]]
                if ways:
                    cost, _, way = min(ways, key=lambda w: w[:2])
                    costs[given, state, role] = cost
                    how[given, state, role] = way
    return costs, how


COSTS, HOW = _moves()


def forward(given: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Least costs of each state before the first and after each turn."""
    out = np.empty((len(given) + 1, 4), np.int64)
    out[0] = start
    steps = COSTS.tolist()
    value = start.tolist()
    for at, role in enumerate(given.tolist()):
        step = steps[role]
        value = [min(value[s] + step[s][q] for s in range(4)) for q in range(4)]
        out[at + 1] = value
    return np.minimum(out, FAR)


def backward(given: np.ndarray, values: np.ndarray, end: int) -> list[int]:
    """The states of the cheapest way to ``end``, one more than turns."""
    states = [end]
    table, steps = values.tolist(), COSTS.tolist()
    for at in range(len(given) - 1, -1, -1):
        step, before, now = steps[given[at]], table[at], states[-1]
        totals = [before[s] + step[s][now] for s in range(4)]
        states.append(totals.index(min(totals)))
    return states[::-1]


def product(given: np.ndarray) -> np.ndarray:
    """Least costs from each state to each state over some turns."""
    rows = []
    for state in range(4):
        start = np.full(4, FAR, np.int64)
        start[state] = 0
        rows.append(forward(given, start)[-1])
    return np.stack(rows)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each conversation in a range, together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch["conv_id"].to_pylist()
        borders = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
        if held and held[-1]["conv_id"][0].as_py() != ids[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(borders, borders[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _given(table: pa.Table) -> np.ndarray:
    return table["given"].to_numpy().astype(np.int64)


def _vector(name: str) -> str:
    return f"{name} array<bigint>"


def _borders(crossing: DataFrame) -> DataFrame:
    """For the pieces of conversations in several ranges: ``conv_id, _part, costs``
    (the least costs at their beginning) and ``last``."""
    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            yield pa.RecordBatch.from_arrays(
                [piece["conv_id"].combine_chunks().slice(0, 1),
                 piece["_part"].combine_chunks().slice(0, 1),
                 pa.array([product(_given(piece)).ravel().tolist()], pa.list_(pa.int64()))],
                ["conv_id", "_part", "matrix"])

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part")
        value = np.array([0, FAR, FAR, FAR], np.int64)
        starts = []
        for matrix in pdf["matrix"]:
            starts.append(value.tolist())
            steps = np.asarray(matrix, np.int64).reshape(4, 4)
            value = np.minimum((value[:, None] + steps).min(axis=0), FAR)
        end = int(np.argmin(value + FINAL))
        return pd.DataFrame({"conv_id": pdf["conv_id"], "_part": pdf["_part"],
                             "costs": starts, "final": end})

    pieces = crossing.mapInArrow(matrices, f"conv_id bigint, _part bigint, {_vector('matrix')}")
    return pieces.groupBy("conv_id").applyInPandas(
        combine, f"conv_id bigint, _part bigint, {_vector('costs')}, final bigint")


def _ends(crossing: DataFrame) -> DataFrame:
    """``conv_id, _part, costs, end, last``: also the state at each piece's end."""
    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            given, costs = _given(piece), piece["costs"][0].as_py()
            values = forward(given, np.array(costs, np.int64))
            begins = [backward(given, values, end)[0] for end in range(4)]
            yield pa.RecordBatch.from_arrays(
                [piece["conv_id"].combine_chunks().slice(0, 1),
                 piece["_part"].combine_chunks().slice(0, 1),
                 pa.array([costs], pa.list_(pa.int64())),
                 piece["final"].combine_chunks().slice(0, 1),
                 pa.array([begins], pa.list_(pa.int64()))],
                ["conv_id", "_part", "costs", "final", "begins"])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part")
        state, ends = int(pdf["final"].iloc[0]), []
        for begins in reversed(pdf["begins"].tolist()):
            ends.append(state)
            state = int(begins[state])
        return pd.DataFrame({"conv_id": pdf["conv_id"], "_part": pdf["_part"],
                             "costs": pdf["costs"], "end": ends[::-1],
                             "last": [False] * (len(pdf) - 1) + [True]})

    known = f"conv_id bigint, _part bigint, {_vector('costs')}"
    return (crossing.mapInArrow(ways, f"{known}, final bigint, {_vector('begins')}")
            .groupBy("conv_id").applyInPandas(chain, f"{known}, end bigint, last boolean"))


def _fragments(piece: pa.Table) -> list[tuple]:
    """Operation, role, cost and rendered text of each row of a piece."""
    given = _given(piece)
    costs = piece["costs"][0].as_py() or [0, FAR, FAR, FAR]
    values = forward(given, np.array(costs, np.int64))
    end, last = piece["end"][0].as_py(), piece["last"][0].as_py()
    if end is None:
        end, last = int(np.argmin(values[-1] + FINAL)), True
    states = backward(given, values, end)
    out = []
    for at, text in enumerate(piece["text"].to_pylist()):
        before, role, named = states[at], states[at + 1], int(given[at])
        way = HOW[named, before, role]
        cost = int(COSTS[named, before, role])
        if way == "merge":
            action, shown = "merge", "\n"
        else:
            action = "insert" if way != "turn" else "keep" if role == named else "relabel"
            shown = CLOSE if before != START else ""
            if way != "turn":
                shown += OPEN.format(NAMES[way]) + CLOSE
            shown += OPEN.format(NAMES[role])
        shown += text or ""
        if last and at == len(given) - 1:
            shown += CLOSE + "".join(OPEN.format(NAMES[s]) + CLOSE for s in ENDING[end])
            cost += int(FINAL[end])
        out.append((action, NAMES[role], cost, shown))
    return out


def repaired(turns: DataFrame) -> DataFrame:
    """One row per row of ``turns``: ``conv_id, turn, role, place`` (the order within a
    conversation), ``action``, ``new_role``, ``cost`` and ``rendered``."""
    given = F.lit(0)
    for number, name in enumerate(ROLES, 1):
        given = F.when(F.col("role") == name, number).otherwise(given)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role",
                        "text", given.alias("given"),
                        F.monotonically_increasing_id().alias("_n"))
    placed = range_placed(rows, ["conv_id"], [F.col(c) for c in ("turn", "role", "text", "_n")])
    several = staged(placed.groupBy("conv_id").agg(F.min("_part").alias("a"),
                                                   F.max("_part").alias("b"))
                     .filter("a < b").select(F.col("conv_id").alias("_conv"),
                                             F.lit(True).alias("_cut")), "crossing")
    light = placed.select("conv_id", "given", "_part")
    # as many as there are borders between ranges
    few = small_side(several)
    crossing = light.join(few, light["conv_id"].eqNullSafe(few["_conv"])).select(
        "conv_id", "given", "_part")
    begun = staged(_borders(crossing), "borders").select(
        F.col("conv_id").alias("_conv"), F.col("_part").alias("_range"), "costs", "final")
    at = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_part") == F.col("_range"))
    ended = staged(_ends(crossing.join(small_side(begun), at)
                         .select("conv_id", "given", "_part", "costs", "final")), "ends")
    ended = ended.select(F.col("conv_id").alias("_conv"), F.col("_part").alias("_range"),
                         "costs", "end", "last")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            done = _fragments(piece)
            table = piece.select(["conv_id", "turn", "role", "_row"]).rename_columns(
                ["conv_id", "turn", "role", "place"])
            for name, kind, column in zip(
                    ("action", "new_role", "cost", "rendered"),
                    (pa.string(), pa.string(), pa.int64(), pa.string()), zip(*done)):
                table = table.append_column(name, pa.array(column, kind))
            yield from table.to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in turns.schema.fields}
    return (placed.join(small_side(ended), at, "left")
            .select("conv_id", "turn", "role", "text", "given", "_row", "costs", "end", "last")
            .mapInArrow(render, f"conv_id bigint, turn {kinds['turn']}, role string, "
                        "place bigint, action string, new_role string, cost bigint, "
                        "rendered string"))
