"""Whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def whole_part(value: Column, size: int) -> Column:
    """Integer division, exact for all of bigint."""
    return F.call_function("div", value, F.lit(size))


def rounded(value: Column, places: int) -> Column:
    """A double rounded half away from zero, as SQL engines do: what is below zero, or
    minus zero, and rounds to zero keeps its sign."""
    near = F.round(value, places)
    return F.when(near == 0, F.signum(value) * 0.0).otherwise(near)
