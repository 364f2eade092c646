"""Training sequences out of encoded turns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from colloquy.config import SpecialIds
from colloquy.functions.numbers import whole_part


def _ints(*values: int) -> Column:
    return F.array(*[F.lit(v).cast("int") for v in values])


def speaker_roles(history: Column, ids: SpecialIds) -> Column:
    """One speaker id per history turn: the turn next to the response is the
    other speaker, and the two alternate going back."""
    pairs = whole_part(F.size(history) + 1, 2).cast("int")
    alternating = F.flatten(F.array_repeat(_ints(ids.sp1, ids.sp2), pairs))
    return F.slice(alternating, 2 * pairs - F.size(history) + 1, F.size(history))


def truncated_turns(history: Column, ids: SpecialIds, max_len: int) -> Column:
    """Each turn led by its speaker id, cut to ``max_len`` ids in all."""
    return F.zip_with(
        speaker_roles(history, ids), history,
        lambda role, turn: F.slice(F.concat(F.array(role), turn), 1, max_len))


def input_sequence(turns: Column, ids: SpecialIds) -> Column:
    """Begin token, the truncated turns, the mark that opens the response."""
    return F.concat(_ints(ids.bos), F.flatten(turns), _ints(ids.sp1))


def token_types(inputs: Column, ids: SpecialIds) -> Column:
    """History type for all of an input sequence but its last id."""
    return F.concat(
        F.array_repeat(F.lit(ids.hst).cast("int"), F.size(inputs) - 1),
        _ints(ids.rsp))


def target_sequence(turn: Column, ids: SpecialIds, max_len: int) -> Column:
    """The first ``max_len`` ids of the response and the end token."""
    return F.concat(F.slice(turn, 1, max_len), _ints(ids.eos))


def response_types(target: Column, ids: SpecialIds) -> Column:
    return F.array_repeat(F.lit(ids.rsp).cast("int"), F.size(target))


def truncate_at_eos(generated: Column, eos: int, max_len: int) -> Column:
    """Generated ids before the first end token, at most ``max_len``."""
    at = F.array_position(generated, F.lit(eos).cast("int"))
    kept = F.when(at == 0, F.size(generated)).otherwise(at - 1)
    return F.slice(generated, F.lit(1), F.least(kept.cast("int"), F.lit(max_len)))


def extend_inputs(input_ids: Column, predicted: Column, ids: SpecialIds,
                  layout: str) -> Column:
    """Prompt ids followed by the predicted ones; the permuted layout gets one
    more slot to predict into."""
    tail = [_ints(ids.mask)] if layout == "permuted" else []
    return F.concat(input_ids, predicted, *tail)


def extend_types(type_ids: Column, predicted: Column, ids: SpecialIds,
                 layout: str) -> Column:
    """Token types that go with :func:`extend_inputs`."""
    tail = [_ints(ids.rsp)] if layout == "permuted" else []
    return F.concat(type_ids, response_types(predicted, ids), *tail)
