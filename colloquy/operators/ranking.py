"""Row numbers and running totals over groups too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions.numbers import whole_part
from colloquy.session import durable

BROADCAST_PARTS = 100_000


def small_side(df: DataFrame, rows: int = BROADCAST_PARTS) -> DataFrame:
    """``df`` marked for broadcast if it has no more than ``rows`` rows of small values."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# Longest sequence that is spelled out within one row.
BLOCK = 4096


def counted_out(df: DataFrame, last: Column, name: str) -> DataFrame:
    """One row for each number from 0 to ``last``, block by block, so that a
    large ``last`` does not become one large array."""
    blocks = F.sequence(F.lit(0).cast("bigint"), whole_part(last, BLOCK))
    start = F.col("_block") * BLOCK
    return (df.withColumn("_block", F.explode(blocks))
            .withColumn(name, F.explode(F.sequence(
                start, F.least(last, start + (BLOCK - 1)))))
            .drop("_block"))


def _bin_starts(totals: DataFrame, group: list[str], bins: list[str]) -> DataFrame:
    """Add ``_start``, the total of all earlier bins of the group, to rows of
    ``(group, bins, _total)``.

    The last bin column is summed up within the others, and those in turn, so
    a window sees the values of one column only.
    """
    inside = Window.partitionBy(*group, *bins[:-1]).orderBy(bins[-1]).rowsBetween(
        Window.unboundedPreceding, -1)
    rows = totals.withColumn("_start", F.coalesce(F.sum("_total").over(inside), F.lit(0)))
    if len(bins) == 1:
        return rows.drop("_total")
    outer_keys = group + bins[:-1]
    outer = _bin_starts(totals.groupBy(*outer_keys).agg(F.sum("_total").alias("_total")),
                        group, bins[:-1]).withColumnRenamed("_start", "_outer")
    return (rows.join(outer, outer_keys)
            .select(*group, *bins, (F.col("_start") + F.col("_outer")).alias("_start")))


def total_before(df: DataFrame, group: list[str], bins: list[str],
                 order: list[Column], name: str, weight: str | None = None) -> DataFrame:
    """Add ``name``: the sum of ``weight`` (or the count) over the rows that come
    earlier in the group, in the order of ``bins`` and then ``order``.

    Rows are numbered within a bin; the bins' totals, one small row per bin,
    carry the sum from bin to bin. A large group thus spreads over its bins.
    ``df`` is read once for its rows and once per bin column for the totals, so
    give it a table that is cheap to read.
    """
    amount = F.col(weight) if weight else F.lit(1)
    keys = group + bins
    totals = df.groupBy(*keys).agg(F.sum(amount).alias("_total"))
    earlier_rows = Window.partitionBy(*keys).orderBy(*order)
    if weight:
        inside = F.coalesce(F.sum(amount).over(
            earlier_rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        inside = F.row_number().over(earlier_rows).cast("bigint") - 1
    return (df.withColumn("_inside", inside)
            .join(_bin_starts(totals, group, bins), keys)
            .withColumn(name, (F.col("_start") + F.col("_inside")).cast("bigint"))
            .drop("_start", "_inside"))


def range_placed(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Range-partition on group and order, which cuts large groups, and write
    the rows once with the number of their partition and their place in it."""
    keys = [F.col(c) for c in group] + order
    return durable(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_row", 33)))


def with_rank(placed: DataFrame, group: list[str], name: str,
              few_parts: bool | None = None) -> DataFrame:
    """Turn the places of :func:`range_placed` into 0-based ranks by group.

    Each partition's first row and row count per group give the offsets: as
    many rows as partitions and groups together. They are counted before they
    are broadcast unless the caller knows the bound.
    """
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    parts = (placed.groupBy(*group, "_part")
             .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
             .select(*group, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0))
                                       - F.col("_first")).alias("_shift")))
    if few_parts is None:
        few_parts = parts.count() <= BROADCAST_PARTS
    if few_parts:
        parts = F.broadcast(parts)
    return (placed.join(parts, [*group, "_part"])
            .withColumn(name, F.col("_row") + F.col("_shift"))
            .drop("_row", "_part", "_shift"))


def ranked(df: DataFrame, group: list[str], order: list[Column],
           name: str) -> DataFrame:
    """Add ``name``: the 0-based rank of each row in its group, for any order
    that tells rows apart and any group size."""
    return with_rank(range_placed(df, group, order), group, name)
