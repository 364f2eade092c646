"""Shards, order, buckets, batches and padding against plain Python."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from colloquy.config import CorpusConfig, SpecialIds
from colloquy.functions import padding as P
from colloquy.operators import batching as B
from colloquy.operators import collation as C
from colloquy.operators.ranking import counted_out, ranked, total_before
from colloquy.operators.vocabulary import build_vocab, encoded_segments
from colloquy.plans import corpus
from colloquy.plans.tables import conversations

CONFIG = CorpusConfig(file_size=6, bucket_size=10, batch_size=4, seed=3)
IDS = SpecialIds(sp1=101, sp2=102, bos=103, eos=104, hst=105, rsp=106, pad=100)


@pytest.fixture(scope="module")
def plan(spark, sf_dir):
    turns = conversations(spark, sf_dir)
    return B.batch_plan(corpus.text_index(turns, CONFIG), turns, CONFIG).collect()


def test_ranks_with_a_hot_group_and_hot_key(spark):
    draw = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", draw.choice([5, 5, 5, 1, 9]), i)
            for i in range(600)]
    table = spark.createDataFrame(rows, "g string, k int, i bigint")
    place = {}
    for g in {r[0] for r in rows}:
        members = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        place.update({r[2]: n for n, r in enumerate(members)})
    got = ranked(table, ["g"], [F.col("k"), F.col("i")], "n").collect()
    assert {r.i: r.n for r in got} == place
    binned = total_before(table.withColumn("b", F.floor(F.col("i") / 50)), ["g"],
                          ["k", "b"], [F.col("i")], "n").collect()
    assert {r.i: r.n for r in binned} == place
    heavy = total_before(table, ["g"], ["k"], [F.col("i")], "n", weight="i").collect()
    for r in heavy:
        before = [o[2] for o in rows if o[0] == r.g and (o[1], o[2]) < (r.k, r.i)]
        assert r.n == sum(before)


def test_counting_out_crosses_blocks(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 4095), ("c", 4096), ("d", 9000)],
                                 "k string, last bigint")
    got = counted_out(rows, F.col("last"), "i").groupBy("k").agg(
        F.count("i").alias("n"), F.countDistinct("i").alias("d"),
        F.min("i").alias("low"), F.max("i").alias("high")).collect()
    assert {r.k: (r.n, r.d, r.low, r.high) for r in got} == {
        "a": (1, 1, 0, 0), "b": (4096, 4096, 0, 4095), "c": (4097, 4097, 0, 4096),
        "d": (9001, 9001, 0, 9000)}


def test_each_example_is_in_one_batch(plan):
    keys = [(r.conv_id, r.begin_idx, r.end_idx) for r in plan]
    assert len(keys) == len(set(keys)) == 114
    shards = defaultdict(list)
    for r in plan:
        shards[r.split, r.shard].append(r)
    for rows in shards.values():
        assert sorted(r.draw for r in rows) == list(range(len(rows)))
        by_position = sorted(rows, key=lambda r: r.position)
        assert [r.example_len for r in by_position] == sorted(r.example_len for r in rows)
        # stable: corpus order among equals
        assert by_position == sorted(rows, key=lambda r: (
            r.example_len, r.conv_id, r.end_idx, r.begin_idx))
        for r in rows:
            assert r.bucket == r.position // CONFIG.bucket_size
            assert r.batch == r.draw // CONFIG.batch_size
            mates = [m for m in rows if m.batch == r.batch]
            assert r.max_seq == max(m.input_len for m in mates)
            assert r.max_target == max(m.target_len for m in mates)
        # buckets stay together, and only training rows are shuffled within
        for bucket in {r.bucket for r in rows}:
            own = sorted((r for r in rows if r.bucket == bucket), key=lambda r: r.draw)
            draws = [r.draw for r in own]
            assert draws == list(range(draws[0], draws[0] + len(own)))
            if own[0].split != "train":
                assert [r.position for r in own] == sorted(r.position for r in own)


@pytest.mark.parametrize("partitions", ["1", "4", "64"])
def test_batches_do_not_depend_on_partitioning(spark, sf_dir, plan, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        turns = conversations(spark, sf_dir).repartition(5)
        again = B.batch_plan(corpus.text_index(turns, CONFIG), turns, CONFIG).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, again)) == sorted(map(tuple, plan))


def test_epochs_shuffle_anew(spark, sf_dir, plan):
    other = CorpusConfig(file_size=6, bucket_size=10, batch_size=4, seed=3, epoch=1)
    turns = conversations(spark, sf_dir)
    again = B.batch_plan(corpus.text_index(turns, other), turns, other).collect()
    draw = lambda rows: {(r.conv_id, r.begin_idx, r.end_idx): r.draw for r in rows}
    assert draw(again) != draw(plan) and draw(again).keys() == draw(plan).keys()


@pytest.mark.parametrize("world", [1, 2, 7, 64])
def test_ranks_get_equal_shares(spark, sf_dir, world):
    turns = conversations(spark, sf_dir)
    placed = B.placed(corpus.text_index(turns, CONFIG),
                      B.dialog_layout(turns, CONFIG), CONFIG)
    originals = defaultdict(dict)
    for r in placed.collect():
        originals[r.split, r.shard][r.ordinal] = (r.conv_id, r.begin_idx, r.end_idx)
    dealt = defaultdict(list)
    for r in B.rank_share(placed, world).collect():
        dealt[r.split, r.shard].append((r["rank"], r.ordinal, (r.conv_id, r.begin_idx, r.end_idx)))
    for shard, rows in originals.items():
        n = len(rows)
        total = -(-n // world) * world
        want = [(p % world, p // world, rows[p % n]) for p in range(total)]
        assert sorted(dealt[shard]) == sorted(want)


def test_steps(spark):
    manifest = spark.createDataFrame([("train", 130)], "split string, n_examples bigint")
    config = CorpusConfig(batch_size=64, world_size=2)
    assert B.num_steps(manifest, config).first().n_steps == 2


def brute_train_mask(prompt, target, size):
    length = prompt + target
    mask = [[0] * size for _ in range(size)]
    for row in range(length):
        hidden = target - max(row + 1 - prompt, 0) + (size - length) + 1
        for i in range(hidden):
            mask[row][size - 1 - i] = 1
    for row in range(length, size):
        mask[row] = [1] * size
    return mask


def test_masks_against_the_fill_rule(spark):
    cases = [(p, t, m) for p in range(2, 7) for t in range(1, 5)
             for m in range(p + t, p + t + 4)]
    table = spark.createDataFrame(cases, "p bigint, t bigint, m bigint")
    length = F.col("p") + F.col("t")
    rows = table.select(
        "*",
        P.mask_numbers(P.permutation_mask(F.col("p"), length, F.col("m"))).alias("perm"),
        P.mask_numbers(P.target_map(F.col("p"), length, F.col("t") + 1, F.col("m"))).alias("map"),
        P.mask_numbers(P.next_slot_mask(length, F.col("m"))).alias("eval_perm"),
        P.mask_numbers(P.next_slot_map(length, F.col("m"))).alias("eval_map"),
        P.attention(length, F.col("m")).alias("attn")).collect()
    for r in rows:
        u = r.p + r.t
        assert r.perm == brute_train_mask(r.p, r.t, r.m)
        assert r.map == [[int(c == r.p + t and t < r.t) for c in range(r.m)]
                         for t in range(r.t + 1)]
        assert r.eval_perm == [[int(c >= u - 1) for c in range(r.m)]] * r.m
        assert r.eval_map == [[int(c == u - 1) for c in range(r.m)]]
        assert r.attn == [1] * u + [0] * (r.m - u)


def test_worked_mask(spark):
    row = spark.range(1).select(
        P.permutation_mask(F.lit(2), F.lit(4), F.lit(5)),
        P.target_map(F.lit(2), F.lit(4), F.lit(2), F.lit(5))).first()
    assert row[0] == ["01111", "01111", "00111", "00011", "11111"]
    assert row[1] == ["00100", "00010"]


def test_causal_layout(spark):
    rows = spark.createDataFrame(
        [(1, 0, 1, "train", 0, 0, 11, [103, 102, 1, 2, 101, 3, 104],
          [105] * 4 + [106] * 3, [3, 104])],
        "conv_id bigint, begin_idx bigint, end_idx bigint, split string, shard bigint, "
        "batch bigint, max_seq bigint, input_ids array<int>, token_type_ids array<int>, "
        "target_ids array<int>")
    got = C.collate(rows, "causal", IDS.pad).first()
    assert got.input_ids == [103, 102, 1, 2, 101, 3, 104, 100, 100, 100]
    assert got.labels == [100, 100, 100, 100, 3, 104, 100, 100, 100, 100]
    assert got.token_type_ids == [105] * 4 + [106] * 3 + [100] * 3
    plain = C.collate(rows, "causal", training=False).first()
    assert plain.input_ids == [103, 102, 1, 2, 101, 3, 104] + [50261] * 4
    with pytest.raises(ValueError, match="layout"):
        C.collate(rows, "other")


def test_padded_sizes_are_equal_within_a_batch(spark, sf_dir):
    rows, ids = corpus.text_batches(conversations(spark, sf_dir), CONFIG)
    sizes = defaultdict(set)
    for r in C.collate(rows, "permuted", ids.pad).collect():
        sizes[r.split, r.shard, r.batch].add(
            (len(r.input_ids), len(r.token_type_ids), len(r.labels), len(r.attention_mask)))
    assert all(len(s) == 1 for s in sizes.values())


def exchanges(df):
    """The columns of each shuffle in a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", keys)
            for keys in re.findall(r"Exchange hashpartitioning\((.*), \d+\)", plan)]


def test_collation_shuffles_the_text_once(spark, sf_dir):
    turns = conversations(spark, sf_dir)
    vocab = build_vocab(turns)
    rows = B.batch_plan(corpus.text_index(turns, CONFIG), turns, CONFIG).checkpoint()
    encoded = encoded_segments(turns, vocab, CONFIG.max_hist, CONFIG.max_len)
    found = exchanges(C.batch_rows(rows, encoded, vocab.ids, CONFIG))
    # one for the text, one for the plan's slots
    assert [keys for keys in found if "conv_id" in keys] == ["conv_id, segment"] * 2


def test_length_order_cuts_a_hot_length(spark):
    rows = spark.range(5000).select(
        F.lit("train").alias("split"), F.lit(0).cast("bigint").alias("shard"),
        F.lit(9).alias("example_len"), F.col("id").alias("ordinal"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = B.length_order(rows)
        parts = got.select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parts > 1 and all(r.position == r.ordinal for r in got.collect())
    # after the range shuffle only offsets move, a row per range
    assert len(exchanges(B.length_order(rows))) <= 2
