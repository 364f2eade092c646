"""Running epoch means over a stream of step metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stream_epoch_means(steps: DataFrame, delay: str | None = None) -> DataFrame:
    """Mean loss per run and day of ``ts``, updated as steps arrive.

    An epoch is a day here. Steps may come in any order; without ``delay`` the sums
    of all epochs are kept, one small row each. With it, an epoch's state is
    dropped once the watermark passes it, and ``drain_update`` raises if a
    step came too late for that.
    """
    rows = steps.withWatermark("ts", delay) if delay else steps
    return (rows.groupBy("run_id", F.window("ts", "1 day").alias("day"))
            .agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n_steps")))


def latest(updates: DataFrame) -> DataFrame:
    """The last update of each epoch out of a log of updates."""
    return (updates.groupBy("run_id", "day")
            .agg(F.max_by(F.struct("loss", "n_steps"), "batch").alias("last"))
            .select("run_id", "day", "last.*"))
