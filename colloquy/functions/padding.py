"""Padding and attention layouts; one row per example, sizes known per batch.

Below P is the prompt length, U the whole sequence, M the batch's longest.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _fill(value: int, count: Column) -> Column:
    return F.array_repeat(F.lit(value).cast("int"),
                          F.greatest(count, F.lit(0)).cast("int"))


def pad_to(ids: Column, size: Column, pad: int) -> Column:
    return F.concat(ids, _fill(pad, size - F.size(ids)))


def next_token_labels(ids: Column, target: Column, size: Column, pad: int) -> Column:
    """Labels aligned with the inputs before shifting: pad over the prompt,
    then the target, then pad."""
    return F.concat(_fill(pad, F.size(ids) - F.size(target)), target,
                    _fill(pad, size - F.size(ids)))


def drop_last(ids: Column) -> Column:
    return F.slice(ids, F.lit(1), F.size(ids) - 1)


def drop_first(ids: Column) -> Column:
    return F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))


def attention(length: Column, size: Column) -> Column:
    return F.concat(_fill(1, length), _fill(0, size - length))


def _digits(digit: str, count: Column) -> Column:
    return F.repeat(F.lit(digit), F.greatest(count, F.lit(0)).cast("int"))


def _step(zeros: Column, size: Column) -> Column:
    """``zeros`` zeros, then ones up to ``size``, as text."""
    return F.concat(_digits("0", zeros), _digits("1", size - zeros))


def _mark(at: Column, size: Column) -> Column:
    """A single one at position ``at``, as text."""
    return F.concat(_digits("0", at), F.lit("1"), _digits("0", size - at - 1))


def _rows(count: Column) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1)


def permutation_mask(prompt: Column, length: Column, size: Column) -> Column:
    """Rows of what each position must not see: itself and all later response
    positions and padding; a padded position sees nothing.

    Masks are arrays of rows of digits, an eighth of the size of numbers; see
    :func:`mask_numbers`.
    """
    return F.transform(_rows(size), lambda row: _step(
        F.when(row >= length, F.lit(0)).otherwise(F.greatest(row, prompt - 1)), size))


def target_map(prompt: Column, length: Column, targets: Column, size: Column) -> Column:
    """Row ``t`` marks the position of the ``t``-th target id."""
    return F.transform(_rows(targets), lambda t: F.when(
        t < length - prompt, _mark(prompt + t, size)).otherwise(_digits("0", size)))


def next_slot_mask(length: Column, size: Column) -> Column:
    """The mask when one last slot is predicted: nobody sees it or padding."""
    return F.array_repeat(_step(length - 1, size), size.cast("int"))


def next_slot_map(length: Column, size: Column) -> Column:
    return F.array(_mark(length - 1, size))


def mask_numbers(mask: Column) -> Column:
    """A mask as ``array<array<int>>``."""
    return F.transform(mask, lambda row: F.split(row, "").cast("array<int>"))
