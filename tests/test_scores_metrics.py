"""Decoding filters, losses and run history."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import scores
from colloquy.functions.numbers import rounded
from colloquy.operators import decoding as D
from colloquy.operators import metrics as M
from colloquy.plans.queries import QUERIES
from colloquy.plans.tables import logit_table

INF = float("inf")


def logits(spark, *rows):
    return spark.createDataFrame(
        [(i, 0, [float(x) for x in r]) for i, r in enumerate(rows)],
        "seq_id bigint, pos int, logits array<double>")


def kept_ids(kept):
    return {r.seq_id: [c.token_id for c in r.kept] for r in kept.collect()}


def test_top_k_keeps_ties(spark):
    table = logits(spark, [3, 2, 2, 1], [1, 2, 3, 4])
    assert kept_ids(D.select(table, "topk", top_k=2)) == {0: [0, 1, 2], 1: [3, 2]}
    assert kept_ids(D.select(table, "topk", top_k=9)) == {0: [0, 1, 2, 3], 1: [3, 2, 1, 0]}


def test_nucleus_prefix(spark):
    table = logits(spark, np.log([.5, .3, .15, .05]), [0, 9, 0, 0])
    assert kept_ids(D.select(table, "nucleus", top_p=0.7)) == {0: [0, 1], 1: [1]}
    with pytest.raises(ValueError, match="method"):
        D.select(table, "beam")


def test_early_end_is_banned(spark):
    table = logits(spark, [5, 1, 2])
    banned = D.mask_early_end(table, 0, 2).first().logits
    assert banned == [-INF, 1.0, 2.0]
    later = table.withColumn("pos", F.lit(2))
    assert D.mask_early_end(later, 0, 2).first().logits == [5.0, 1.0, 2.0]
    kept = D.select(D.mask_early_end(table, 0, 2), "nucleus", top_p=0.999999)
    assert 0 not in kept_ids(kept)[0]


def test_rounding_keeps_the_sign_of_zero(spark, tmp_path):
    values = [0.0, 3e-7, -3e-7, -0.0, -5e-7, 0.1234565, -INF, float("nan")]
    spark.createDataFrame([(n, [v / 10], 0) for n, v in enumerate(values)],
                          "vec_id bigint, embedding array<double>, label int"
                          ).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = QUERIES["min_len_mask"](spark, str(tmp_path)).where("pos >= 2").collect()
    got = {r.seq_id * 4 + r.pos: str(r.logit) for r in rows}
    assert got == {2: "-0.0", 3: "-0.0", 6: "-inf", 7: "nan"}
    table = spark.createDataFrame([(v,) for v in values], "v double")
    assert [str(r.v) for r in table.select(rounded(F.col("v"), 6).alias("v")).collect()] == [
        "0.0", "0.0", "-0.0", "-0.0", "-1e-06", "0.123457", "-inf", "nan"]


def test_against_numpy(spark, sf_dir):
    table = logit_table(spark, sf_dir)
    rows = table.select("*", scores.log_softmax(F.col("logits")).alias("lp")).collect()
    for r in rows[:60]:
        x = np.array(r.logits)
        want = x - x.max() - math.log(np.exp(x - x.max()).sum())
        assert np.allclose(r.lp, want)
    kept = kept_ids(D.select(table.withColumn("seq_id", F.col("seq_id") * 4 + F.col("pos")),
                             "nucleus", top_p=0.8))
    for r in rows[:60]:
        x = np.array(r.logits)
        order = np.lexsort((np.arange(len(x)), -x))
        p = np.exp(x[order] - x.max())
        p /= p.sum()
        before = np.concatenate([[0], np.cumsum(p)[:-1]])
        assert kept[r.seq_id * 4 + r.pos] == list(order[before <= 0.8])


def test_draws_follow_the_weights(spark):
    table = spark.range(4000).select(
        F.col("id").alias("seq_id"), F.lit(0).alias("pos"),
        F.array(*[F.lit(math.log(p)) for p in (.6, .3, .1)]).alias("logits"))
    drawn = D.sample(D.select(table, "topk", top_k=2), seed=1)
    share = {r.token_id: r["count"] / 4000 for r in drawn.groupBy("token_id").count().collect()}
    assert set(share) == {0, 1} and abs(share[0] - 2 / 3) < 0.03
    again = D.sample(D.select(table, "topk", top_k=2), seed=1)
    assert drawn.exceptAll(again).isEmpty()


def test_token_metrics(spark):
    table = logits(spark, [2, 1, 0], [0, 5, 1], [9, 9, 9]).withColumn(
        "target", F.when(F.col("seq_id") == 2, 7).otherwise(F.lit(0)))
    row = M.token_metrics(table.withColumn("b", F.lit(1)), pad=7, group=["b"]).first()
    nll = [math.log(1 + math.exp(-1) + math.exp(-2)),
           5 + math.log(1 + math.exp(-5) + math.exp(-4))]
    assert row.n_targets == 2 and row.acc == 0.5
    assert row.loss == pytest.approx(sum(nll) / 2)
    assert row.ppl == pytest.approx(math.exp(sum(nll) / 2))


def steps(spark, rows):
    return spark.createDataFrame(
        rows, "run_id int, epoch int, split string, step int, "
              "loss double, acc double, ppl double")


def test_epoch_means_and_missing_splits(spark):
    table = steps(spark, [(1, 0, "train", 0, 1.0, 0.0, math.e),
                          (1, 0, "train", 1, 3.0, 1.0, math.e ** 3),
                          (1, 0, "train", 2, float("nan"), 1.0, 1.0)])
    row = M.history(M.without_nan(table)).first()
    assert row.train_loss == 2.0 and row.train_ppl == pytest.approx(11.4019, abs=1e-4)
    assert row.valid_loss is None and row.valid_ppl is None and row.n_steps == 2
    skips = M.nan_skips(table, ["run_id"]).first()
    assert (skips.n_steps, skips.n_skipped) == (2, 1)


def test_epoch_means_add_in_step_order(spark):
    """To the last bit, wherever the rows lie: rounding turns on it."""
    draw = random.Random(3)
    rows = [(run, 0, split, step, draw.randrange(1, 40_000) / 10_000, draw.random(),
             math.exp(draw.random() * 4))
            for run in range(40) for split in ("train", "valid")
            for step in range(draw.choice((8, 80)))]
    mixed = draw.sample(rows, len(rows))
    got = {r.run_id: r for r in M.history(steps(spark, mixed).repartition(7, "step")).collect()}
    for run in range(40):
        for split in ("train", "valid"):
            own = [r for r in rows if r[0] == run and r[2] == split]
            for place, name in enumerate(M.METRICS, 4):
                total = 0.0
                for r in own:
                    total += r[place]
                assert got[run][f"{split}_{name}"] == total / len(own)
        assert got[run].n_steps == sum(r[0] == run and r[2] == "train" for r in rows)


def test_log_events_are_finite(spark):
    table = steps(spark, [(1, 0, "valid", 4, 1.0, 0.5, INF)])
    got = {r.tag: r.value for r in M.metric_events(table).collect()}
    assert got == {"val/loss": 1.0, "val/acc": 0.5, "val/ppl": 1e30}


def wide(spark, losses, n_steps=10):
    return spark.createDataFrame([(1, e, x, n_steps) for e, x in enumerate(losses)],
                                 "run_id int, epoch int, valid_loss double, n_steps int")


def brute_stop(losses, patience, n_steps, total):
    best, waited, best_epoch = INF, 0, None
    for epoch, loss in enumerate(losses):
        if loss is not None and loss < best:
            best, waited, best_epoch = loss, 0, epoch
        elif loss is not None:
            waited += 1
            if waited == patience:
                return epoch, best_epoch, "patience"
        if total is not None and n_steps * (epoch + 1) == total:
            return epoch, best_epoch, "budget"
    return len(losses) - 1, best_epoch, "finished"


@pytest.mark.parametrize("losses", [
    [3, 2, 2, 2.5, 1], [3, 2, 1], [float("nan"), 5, 6, 7, 8], [INF, INF, 3], [1, 2, 3, 0, 4, 5, 6],
    [None, 2, None, 3, None, None, 4, 1], [None, None]])
@pytest.mark.parametrize("patience", [0, 1, 2, 3])
@pytest.mark.parametrize("total", [None, 30])
def test_early_stop(spark, losses, patience, total):
    losses = [None if x is None else float(x) for x in losses]
    row = M.early_stop(wide(spark, losses), patience, total).first()
    assert (row.last_epoch, row.best_epoch, row.reason) == brute_stop(
        losses, patience, 10, total)


def test_early_stop_shuffles_once(spark):
    plan = M.early_stop(wide(spark, [1.0, 2.0]), 1, 10)._jdf.queryExecution()
    assert plan.executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_rank_mean_wants_every_rank(spark):
    ddl = "run_id int, epoch int, split string, step bigint, rank int, loss double, acc double"
    rows = [(1, 0, "train", s, r, float(s + r), 0.5) for s in range(3) for r in range(2)]
    table = spark.createDataFrame(rows + [(1, 0, "train", 3, 0, 9.0, 0.5)], ddl)
    with pytest.raises(Exception, match="each rank"):
        M.rank_mean(table, 2).collect()
    got = {r.step: r.loss for r in M.rank_mean(table, 2, partial=True).collect()}
    assert got == {0: 0.5, 1: 1.5, 2: 2.5, 3: 9.0}
    whole = M.rank_mean(M.whole_steps(table, 2), 2)
    assert {r.step: r.loss for r in whole.collect()} == {0: 0.5, 1: 1.5, 2: 2.5}


def test_summary(spark):
    table = spark.createDataFrame([(1, 2.0), (3, None), (5, 4.0)], "a int, b double")
    got = {r.metric: r for r in M.metric_summary(table, ["a", "b"]).collect()}
    assert got["a"]["mean"] == 3.0 and got["a"]["std"] == 2.0
    assert got["a"].confidence == pytest.approx(1.96 * 2 / math.sqrt(3))
    assert got["b"]["mean"] == 3.0


def test_dealt_steps_use_every_report(spark):
    """Also of one large run, and with fewer reports than ranks."""
    rows = [(run, 0, "train", run % 4, step, float(step), 0.5, 1.0)
            for run, n in ((1, 1001), (2, 3), (3, 8)) for step in range(n)]
    table = spark.createDataFrame(rows, "run_id int, epoch int, split string, rank int, "
                                        "step bigint, loss double, acc double, ppl double")
    dealt = M.dealt_steps(table, 4)
    assert dealt.count() == len(rows)
    means = {(r.run_id, r.step): r.loss for r in M.rank_mean(dealt, 4, partial=True).collect()}
    assert means[1, 0] == 1.5 and means[1, 250] == 1000.0 and means[2, 0] == 1.0
    assert len(means) == 251 + 1 + 2
