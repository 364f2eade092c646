"""Loss, accuracy and perplexity, from tokens to epochs, and run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions import scores
from colloquy.operators.ranking import ranked

METRICS = ("loss", "acc", "ppl")
HISTORY = ("epoch", *[f"{s}_{m}" for s in ("train", "valid") for m in METRICS])


def token_metrics(logits: DataFrame, pad: int, group: list[str]) -> DataFrame:
    """Mean loss, accuracy and perplexity per batch over non-pad targets.

    Takes ``logits`` and ``target`` columns next to the ``group`` ones.
    """
    own = F.element_at("logits", F.col("target") + 1)
    hit = (scores.argmax(F.col("logits")) == F.col("target")).cast("double")
    return (logits.where(F.col("target") != pad)
            .select(*group, (scores.log_normalizer(F.col("logits")) - own).alias("_nll"),
                    hit.alias("_hit"))
            .groupBy(*group)
            .agg(F.count(F.lit(1)).alias("n_targets"),
                 F.avg("_nll").alias("loss"), F.avg("_hit").alias("acc"))
            .withColumn("ppl", F.exp("loss")))


def without_nan(steps: DataFrame) -> DataFrame:
    """Training skips the steps whose loss is NaN."""
    return steps.where(~F.isnan("loss"))


def nan_skips(steps: DataFrame, group: list[str]) -> DataFrame:
    """Steps taken and skipped."""
    return steps.groupBy(*group).agg(
        F.count_if(~F.isnan("loss")).alias("n_steps"),
        F.count_if(F.isnan("loss")).alias("n_skipped"))


def clamped(value: Column) -> Column:
    """A finite stand-in for infinity, for logs."""
    return F.when(value == float("inf"), F.lit(1e30)).otherwise(value)


def epoch_metrics(steps: DataFrame) -> DataFrame:
    """Unweighted means of the batch values per ``(run_id, epoch, split)`` and ``n_steps``.

    Values are added in the order of ``step``, so a mean that lies halfway between two
    places is rounded the same way however the table is cut into tasks. An epoch's
    steps are sorted and read as a stream, of which no task holds more than a piece.
    """
    order = Window.partitionBy("run_id", "epoch", "split").orderBy("step", *METRICS)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return (steps.select("run_id", "epoch", "split",
                         *[F.avg(m).over(so_far).alias(m) for m in METRICS],
                         F.count(F.lit(1)).over(so_far).alias("n_steps"),
                         F.lead(F.lit(True)).over(order).isNull().alias("_last"))
            .where("_last").drop("_last"))


def rank_mean(steps: DataFrame, world_size: int, partial: bool = False) -> DataFrame:
    """Per step the mean over the ranks.

    A step that some rank has not reported, or twice, fails the job; with
    ``partial`` the mean is over the reports that there are.
    """
    whole = (F.count(F.lit(1)) == world_size) & (F.count_distinct("rank") == world_size)
    count = F.count(F.lit(1)) if partial else F.when(whole, F.lit(world_size)).otherwise(
        F.raise_error(F.lit("a step without a report of each rank")).cast("int"))
    return steps.groupBy("run_id", "epoch", "split", "step").agg(
        (F.sum("loss") / count).alias("loss"), (F.sum("acc") / count).alias("acc"))


def whole_steps(steps: DataFrame, world_size: int) -> DataFrame:
    """Number each rank's steps within its epoch and split, and leave out the last
    ones that some rank has not reached."""
    group = ["run_id", "epoch", "split"]
    numbered = ranked(steps, [*group, "rank"], [F.col("step")], "_number")
    ranks = F.count(F.lit(1)).over(Window.partitionBy(*group, "_number"))
    return (numbered.withColumn("_ranks", ranks).where(F.col("_ranks") == world_size)
            .withColumn("step", F.col("_number")).drop("_ranks", "_number"))


def dealt_steps(steps: DataFrame, world_size: int) -> DataFrame:
    """Deal the reports of each run, epoch and split to the ranks in turn, in the order
    of ``step``: report n goes to rank ``n % world_size`` as its step
    ``n // world_size``. Only the last step of an epoch can lack ranks."""
    numbered = ranked(steps.drop("rank"), ["run_id", "epoch", "split"], [F.col("step")],
                      "_number")
    return (numbered.withColumn("rank", (F.col("_number") % world_size).cast("int"))
            .withColumn("step", F.floor(F.col("_number") / world_size)).drop("_number"))


def history(steps: DataFrame) -> DataFrame:
    """One row per run and epoch: means of training and validation side by side, and
    ``n_steps``, the training steps. A split without any step is null."""
    means = [F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}")
             for s in ("train", "valid") for m in METRICS]
    taken = F.max(F.when(F.col("split") == "train", F.col("n_steps")))
    return epoch_metrics(steps).groupBy("run_id", "epoch").agg(
        *means, F.coalesce(taken, F.lit(0)).cast("bigint").alias("n_steps"))


def history_columnar(wide: DataFrame) -> DataFrame:
    """One row per run: each column as a list over the epochs.

    A run's epochs are few by construction: one row per epoch, not per step.
    """
    rows = F.sort_array(F.collect_list(F.struct(*HISTORY)))
    return (wide.groupBy("run_id").agg(rows.alias("_rows"))
            .select("run_id", *[F.col("_rows")[h].alias(h) for h in HISTORY]))


def metric_events(steps: DataFrame) -> DataFrame:
    """Scalar log events ``(run_id, tag, step, value)``."""
    long = steps.unpivot(["run_id", "split", "step"], list(METRICS), "metric", "value")
    return long.select(
        "run_id",
        F.concat(F.when(F.col("split") == "valid", "val").otherwise(F.col("split")),
                 F.lit("/"), F.col("metric")).alias("tag"),
        "step", clamped(F.col("value")).alias("value"))


def with_best(wide: DataFrame) -> DataFrame:
    """Add ``best_before`` and ``improved``: validated, and strictly below all
    earlier epochs."""
    # one row per epoch: a run's window is as short as its history
    earlier = Window.partitionBy("run_id").orderBy("epoch").rowsBetween(
        Window.unboundedPreceding, -1)
    return (wide
            .withColumn("best_before", F.coalesce(
                F.min("valid_loss").over(earlier), F.lit(float("inf"))))
            .withColumn("improved", F.coalesce(
                F.col("valid_loss") < F.col("best_before"), F.lit(False))))


def best_epoch(wide: DataFrame) -> DataFrame:
    """The last improving epoch of each run and its loss."""
    return (with_best(wide).where("improved").groupBy("run_id")
            .agg(F.max("epoch").alias("best_epoch"),
                 F.max_by("valid_loss", "epoch").alias("best_valid_loss")))


def early_stop(wide: DataFrame, patience: int,
               total_steps: int | None = None) -> DataFrame:
    """Per run the last epoch that runs, and why it is the last.

    Stops when ``patience`` validated epochs in a row fail to improve, or after
    the first epoch that ends with exactly ``total_steps`` steps, counted in the
    column ``n_steps``. An epoch without validation neither improves nor counts as a
    failure. A patience of zero never stops. One shuffle, by run.
    """
    run = Window.partitionBy("run_id")
    so_far = run.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    failed = (F.col("valid_loss").isNotNull() & ~F.col("improved")).cast("int")
    rows = with_best(wide).withColumn("_failed", F.sum(failed).over(so_far))
    # the count of failures only grows, so its largest value at an improvement
    # is the one at the last of them
    waited = F.col("_failed") - F.coalesce(
        F.max(F.when(F.col("improved"), F.col("_failed"))).over(so_far), F.lit(0))
    rows = rows.withColumn("_waited", waited)
    spent = F.lit(False)
    if total_steps is not None:
        rows = rows.withColumn("_steps", F.sum("n_steps").over(so_far))
        spent = F.col("_steps") == total_steps
    # an epoch without validation does not run out of patience again
    out_of_patience = (F.col("_waited") == (patience if patience > 0 else -1)) & (failed == 1)
    rows = rows.withColumns({
        "_patience": F.min(F.when(out_of_patience, F.col("epoch"))).over(run),
        "_budget": F.min(F.when(spent, F.col("epoch"))).over(run),
        "_end": F.max("epoch").over(run)})
    last = F.coalesce(F.least("_patience", "_budget"), "_end")
    reason = (F.when(F.col("_patience") <= F.coalesce("_budget", "_patience"), "patience")
              .when(F.col("_budget").isNotNull(), "budget").otherwise("finished"))
    return (rows.withColumns({"last_epoch": last, "reason": reason})
            .groupBy("run_id").agg(
                F.first("last_epoch").alias("last_epoch"),
                F.max(F.when(F.col("improved") & (F.col("epoch") <= F.col("last_epoch")),
                             F.col("epoch"))).alias("best_epoch"),
                F.first("reason").alias("reason")))


def metric_summary(values: DataFrame, names: list[str]) -> DataFrame:
    """Mean, deviation and 95 % interval half-width of numeric columns, as
    ``(metric, mean, std, confidence)``."""
    return (values.select(*[F.col(n).cast("double").alias(n) for n in names])
            .unpivot([], names, "metric", "value")
            .where(F.col("value").isNotNull())
            .groupBy("metric")
            .agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                 (F.lit(1.96) * F.stddev_samp("value")
                  / F.sqrt(F.count("value"))).alias("confidence")))
