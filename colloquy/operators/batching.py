"""Shards, length order, buckets, shuffles, batches and ranks.

All of it runs on index rows of a few numbers; ids and text join in last.
``ordinal`` is an example's place among its shard's examples in corpus order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.config import CorpusConfig
from colloquy.functions.hashing import key_bin, shuffle_key
from colloquy.functions.numbers import whole_part
from colloquy.operators.ranking import counted_out, ranked, total_before
from colloquy.operators.turns import (
    dialog_sizes, examples_before, examples_of, per_segment, segment_of)
from colloquy.session import durable

SHARD = ["split", "shard"]
BATCH = ["split", "shard", "batch"]


def chunk_of(rank: Column, size: int) -> Column:
    """Fixed-size chunks of a 0-based rank."""
    return whole_part(rank, size)


def assign_shards(dialogs: DataFrame, file_size: int) -> DataFrame:
    """Cut each split into shards of ``file_size`` conversations by id.

    Takes one row per ``(split, conv_id)``; adds ``shard`` and ``shard_pos``.
    """
    return (ranked(dialogs, ["split"], [F.col("conv_id")], "_rank")
            .withColumns({"shard": chunk_of(F.col("_rank"), file_size),
                          "shard_pos": F.pmod(F.col("_rank"), F.lit(file_size))})
            .drop("_rank"))


def dialog_layout(turns: DataFrame, config: CorpusConfig) -> DataFrame:
    """Per conversation its shard and the ordinal of its first example."""
    dialogs = dialog_sizes(turns).withColumn(
        "n_examples", examples_of(F.col("n_turns"), config.max_hist))
    # a shard holds at most file_size conversations, so these windows are bounded
    shard = Window.partitionBy(*SHARD)
    earlier = shard.orderBy("shard_pos").rowsBetween(Window.unboundedPreceding, -1)
    return assign_shards(dialogs, config.file_size).withColumns({
        "first_ordinal": F.coalesce(F.sum("n_examples").over(earlier), F.lit(0)),
        "shard_examples": F.sum("n_examples").over(shard)})


def with_shards(turns: DataFrame, layout: DataFrame) -> DataFrame:
    """Add ``split`` and ``shard`` to turns, joined by segment."""
    shards = per_segment(layout).select("conv_id", "segment", *SHARD)
    rows = turns.drop("split").withColumn("segment", segment_of(F.col("turn")))
    return rows.join(shards, ["conv_id", "segment"]).drop("segment")


def placed(index: DataFrame, layout: DataFrame, config: CorpusConfig) -> DataFrame:
    """Add ``split``, ``shard``, ``shard_examples`` and ``ordinal`` to index rows.

    Layout rows are repeated per segment to join on ``(conv_id, segment)``,
    the partitioning that the index already has. The result, a few numbers per
    example, is written once: ordering reads it several times, and the text is
    scanned for lengths only once.
    """
    shards = per_segment(layout).select(
        "conv_id", "segment", *SHARD, "first_ordinal", "shard_examples")
    inside = (examples_before(F.col("end_idx"), config.max_hist)
              + F.col("begin_idx")
              - F.greatest(F.col("end_idx") - config.max_hist, F.lit(0)))
    return durable(index.join(shards, ["conv_id", "segment"])
                   .withColumn("ordinal", F.col("first_ordinal") + inside)
                   .drop("first_ordinal", "segment"))


def rank_share(rows: DataFrame, world_size: int) -> DataFrame:
    """Deal each shard's examples out to ``world_size`` ranks in turn.

    The first examples are dealt again at the end until all ranks hold the
    same number; ``ordinal`` becomes the place within the rank's share.
    """
    size = F.col("shard_examples")
    # repeats of an ordinal lie one shard size apart, below the padded total
    total = chunk_of(size + (world_size - 1), world_size) * world_size
    return (rows
            .withColumn("_place", F.explode(F.sequence("ordinal", total - 1, size)))
            .withColumns({"rank": F.pmod("_place", F.lit(world_size)).cast("int"),
                          "ordinal": chunk_of(F.col("_place"), world_size)})
            .drop("_place"))


def length_order(rows: DataFrame, group: list[str] = SHARD) -> DataFrame:
    """Add ``position``: the 0-based place in a stable sort by length.

    One range shuffle on the whole order, which cuts a hot length as well.
    """
    return ranked(rows, group, [F.col("example_len"), F.col("ordinal")], "position")


def with_buckets(ordered: DataFrame, bucket_size: int) -> DataFrame:
    return ordered.withColumn("bucket", chunk_of(F.col("position"), bucket_size))


def bucket_starts(shard_sizes: DataFrame, config: CorpusConfig) -> DataFrame:
    """Shuffle the buckets of each shard; ``start`` is the number of examples
    in the buckets drawn before.

    Takes ``(split, shard, n_examples)``.
    """
    size = config.bucket_size
    last = chunk_of(F.col("n_examples") - 1, size)
    key = shuffle_key(F.lit(config.seed), F.lit(config.epoch), *map(F.col, SHARD),
                      F.col("bucket"))
    buckets = counted_out(
        shard_sizes.where("n_examples > 0"), last, "bucket").withColumns({
            "n_rows": F.least(F.lit(size), F.col("n_examples") - F.col("bucket") * size),
            "_key": key, "_bin": key_bin(key)})
    return total_before(buckets, SHARD, ["_bin"], [F.col("_key"), F.col("bucket")],
                        "start", weight="n_rows").select(*SHARD, "bucket", "n_rows", "start")


def shuffled(bucketed: DataFrame, starts: DataFrame, config: CorpusConfig) -> DataFrame:
    """Add ``draw``: the place in the epoch's order within the shard.

    Buckets always move; within a bucket only training rows are shuffled.
    """
    key = shuffle_key(F.lit(config.seed), F.lit(config.epoch),
                      F.col("conv_id"), F.col("end_idx"), F.col("begin_idx"))
    train = F.col("split") == "train"
    # a bucket holds at most bucket_size rows
    inside = Window.partitionBy(*SHARD, "bucket").orderBy(
        F.when(train, key), F.col("position"))
    return (bucketed
            .withColumn("_row", F.row_number().over(inside))
            .join(starts.select(*SHARD, "bucket", "start"), [*SHARD, "bucket"])
            .withColumn("draw", F.col("start") + F.col("_row") - 1)
            .drop("start", "_row"))


def with_batches(drawn: DataFrame, batch_size: int) -> DataFrame:
    """Consecutive batches within a shard; the last may be short."""
    return drawn.withColumn("batch", chunk_of(F.col("draw"), batch_size))


def with_batch_sizes(batched: DataFrame) -> DataFrame:
    """Add ``max_seq`` and ``max_target``, the longest of each batch."""
    same = Window.partitionBy(*BATCH)
    return batched.withColumns({"max_seq": F.max("input_len").over(same),
                                "max_target": F.max("target_len").over(same)})


def batch_plan(index: DataFrame, turns: DataFrame, config: CorpusConfig,
               rank: int | None = None) -> DataFrame:
    """The whole chain from index rows to batches; given ``rank``, those of one of
    ``config.world_size`` ranks, which all get equally many."""
    layout = dialog_layout(turns, config)
    sizes = layout.groupBy(*SHARD).agg(F.sum("n_examples").alias("n_examples"))
    rows = placed(index, layout, config)
    if rank is not None:
        if not 0 <= rank < config.world_size:
            raise ValueError(f"rank must be below {config.world_size}, got {rank}")
        rows = rank_share(rows, config.world_size).where(F.col("rank") == rank)
        sizes = sizes.withColumn("n_examples", chunk_of(
            F.col("n_examples") + (config.world_size - 1), config.world_size))
    ordered = length_order(rows)
    drawn = shuffled(with_buckets(ordered, config.bucket_size),
                     bucket_starts(sizes, config), config)
    return with_batch_sizes(with_batches(drawn, config.batch_size))


def num_steps(manifest: DataFrame, config: CorpusConfig) -> DataFrame:
    """Steps per epoch and split from the example counts."""
    share = config.batch_size * config.world_size
    steps = chunk_of(F.col("n_examples") + (share - 1), share)
    return manifest.select("split", "n_examples", steps.alias("n_steps"))


def loader_steps(layout: DataFrame, batch_size: int) -> DataFrame:
    """Batches that the shards really yield: each ends with its own short one."""
    per_shard = layout.groupBy(*SHARD).agg(F.sum("n_examples").alias("n"))
    return (per_shard.groupBy("split")
            .agg(F.sum(chunk_of(F.col("n") + (batch_size - 1), batch_size)).alias("n_batches")))


def padding_budget(batched: DataFrame, config: CorpusConfig) -> DataFrame:
    """Cells and waste per batch, next to the worst case the settings allow."""
    worst = ((config.max_len + 1) * config.max_hist + 1) + (config.max_len + 1)
    return (batched.groupBy(*BATCH)
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.max("input_len").alias("max_seq"),
                 F.sum("input_len").alias("used_cells"))
            .withColumn("cells", F.col("n_rows") * F.col("max_seq"))
            .withColumn("wasted_cells", F.col("cells") - F.col("used_cells"))
            .withColumn("worst_cells",
                        F.lit(worst * config.batch_size).cast("bigint")))


def take_n(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of an order."""
    return rows.orderBy(*order).limit(n)
