"""Example generation against hand-worked fixtures and brute force."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from colloquy.config import CorpusConfig, SpecialIds
from colloquy.functions import sequences as S
from colloquy.operators import evaluation as E
from colloquy.operators import examples as X
from colloquy.operators import splits as P
from colloquy.operators import turns as T
from colloquy.plans import corpus

IDS = SpecialIds(sp1=101, sp2=102, bos=103, eos=104, hst=105, rsp=106, pad=100)
F1 = [[1, 2], [3], [4, 5, 6]]


def id_table(spark, dialogs):
    rows = [(c, t, ids) for c, turns in dialogs.items() for t, ids in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, ids array<int>")
    return table.withColumn("n_ids", F.size("ids"))


def brute_examples(dialog, max_hist, max_len):
    out = {}
    for end in range(1, len(dialog)):
        window = range(max(0, end - max_hist), end)
        length = sum(len(dialog[i]) + 1 for i in window) + len(dialog[end]) + 1
        for begin in window:
            turns = [([102 if (end - 1 - i) % 2 == 0 else 101] + dialog[i])[:max_len]
                     for i in range(begin, end)]
            target = dialog[end][:max_len] + [104]
            ids = [103] + sum(turns, []) + [101] + target
            types = [105] * (1 + sum(map(len, turns))) + [106] * (1 + len(target))
            out[begin, end] = (length, ids, types, target)
    return out


def test_worked_example(spark):
    table = T.with_segments(id_table(spark, {7: F1}), 2)
    rows = X.build_examples(table, IDS, CorpusConfig(max_hist=2, max_len=3)).collect()
    got = {(r.begin_idx, r.end_idx): r for r in rows}
    assert sorted(got) == [(0, 1), (0, 2), (1, 2)]
    assert got[0, 1].example_len == 5 and got[0, 2].example_len == 9
    assert got[1, 2].example_len == 9
    assert got[0, 1].input_ids == [103, 102, 1, 2, 101, 3, 104]
    assert got[0, 2].input_ids == [103, 101, 1, 2, 102, 3, 101, 4, 5, 6, 104]
    assert got[1, 2].input_ids == [103, 102, 3, 101, 4, 5, 6, 104]
    assert got[0, 1].token_type_ids == [105] * 4 + [106] * 3
    assert got[0, 2].token_type_ids == [105] * 6 + [106] * 5
    assert got[1, 2].token_type_ids == [105] * 3 + [106] * 5
    assert got[0, 1].target_ids == [3, 104] and got[1, 2].target_ids == [4, 5, 6, 104]


def test_truncation(spark):
    table = T.with_segments(id_table(spark, {1: [[7, 8, 9], [1, 2, 3, 4]]}), 2)
    row = X.build_examples(table, IDS, CorpusConfig(max_hist=2, max_len=3)).first()
    assert row.input_ids == [103, 102, 7, 8, 101, 1, 2, 3, 104]
    assert row.target_ids == [1, 2, 3, 104]


@pytest.mark.parametrize("max_hist", [1, 2, 3, 7])
@pytest.mark.parametrize("segment", [2, 5, 512])
def test_any_segment_size_gives_the_same_examples(spark, monkeypatch, max_hist, segment):
    monkeypatch.setattr(T, "SEGMENT_TURNS", segment)
    draw = random.Random(3)
    dialogs = {c: [[draw.randrange(50) for _ in range(draw.randrange(0, 6))]
                   for _ in range(n)] for c, n in enumerate([1, 2, 3, 8, 23])}
    config = CorpusConfig(max_hist=max_hist, max_len=4)
    table = id_table(spark, dialogs)
    rows = X.build_examples(T.with_segments(table, max_hist), IDS, config).collect()
    got = {(r.conv_id, r.begin_idx, r.end_idx):
           (r.example_len, r.input_ids, r.token_type_ids, r.target_ids) for r in rows}
    want = {(c, *k): v for c, d in dialogs.items()
            for k, v in brute_examples(d, max_hist, 4).items()}
    assert got == want and len(rows) == len(want)

    sizes = table.select("conv_id", "turn", "n_ids")
    index = {(r.conv_id, r.begin_idx, r.end_idx):
             (r.example_len, r.input_len, r.target_len)
             for r in X.example_index(sizes, config).collect()}
    assert index == {k: (v[0], len(v[1]), len(v[3])) for k, v in want.items()}

    counts = T.dialog_sizes(table).withColumn(
        "n", T.examples_of(F.col("n_turns"), max_hist)).collect()
    assert sum(r.n for r in counts) == len(want)


def test_long_conversation_crosses_segments(spark):
    n = 3 * T.SEGMENT_TURNS + 17
    turns = spark.range(n).select(
        F.lit(5).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.concat(F.lit("t"), "id").alias("text"))
    rows = T.rolling_context(turns, 3).collect()
    assert {r.turn: list(r.context) for r in rows} == {
        t: [f"t{i}" for i in range(max(0, t - 2), t + 1)] for t in range(n)}
    lens = corpus.text_index(turns, CorpusConfig(max_hist=3))
    assert lens.count() == sum(min(t, 3) for t in range(n))


@pytest.mark.parametrize("numbers", [[0, 1, 3], [1, 2], [0, 0, 1], [0, 513]])
def test_gaps_fail_instead_of_giving_wrong_histories(spark, numbers):
    rows = spark.createDataFrame([(1, n, "x") for n in numbers],
                                 "conv_id bigint, turn bigint, text string")
    with pytest.raises(PySparkException, match="renumbered"):
        T.rolling_context(rows, 2).collect()


@pytest.mark.parametrize("numbers", [[0, 2, 3], [0, 1, 1, 2], [3, 4], [*range(512), 513]])
@pytest.mark.parametrize("operator", [
    lambda rows, config: P.split_manifest(rows, config),
    lambda rows, config: E.word_vocab(T.with_split(rows), config),
    lambda rows, config: X.history_band_join(rows, config.max_hist),
    lambda rows, config: X.running_example_len(corpus.token_counts(rows), config),
    lambda rows, config: corpus.text_index(rows, config)])
def test_every_turn_operator_refuses_gaps(spark, operator, numbers):
    rows = spark.createDataFrame([(1, n, f"w{n}") for n in numbers],
                                 "conv_id bigint, turn bigint, text string")
    with pytest.raises(PySparkException, match="renumbered"):
        operator(rows, CorpusConfig(max_hist=2)).collect()


def test_checked_turns_are_the_turns(spark):
    rows = spark.range(1100).select(F.lit(1).cast("bigint").alias("conv_id"),
                                    F.col("id").alias("turn"))
    assert sorted(r.turn for r in T.checked(rows).collect()) == list(range(1100))


def test_renumbering_closes_gaps(spark):
    numbers = [3, 4, 900, 2000, 2001]
    rows = spark.createDataFrame(
        [(1, n, str(n)) for n in numbers] + [(2, 70_000, "a"), (2, 70_001, "b")],
        "conv_id bigint, turn bigint, text string")
    got = sorted((r.conv_id, r.turn, r.text) for r in T.renumbered(rows).collect())
    assert got == [(1, i, str(n)) for i, n in enumerate(numbers)] + [(2, 0, "a"), (2, 1, "b")]


def test_band_join_pairs(spark, turn_table):
    pairs = X.history_band_join(turn_table({1: list("abcd"), 2: ["x"]}), 2).collect()
    assert sorted((p.conv_id, p.begin_idx, p.end_idx) for p in pairs) == [
        (1, 0, 1), (1, 0, 2), (1, 1, 2), (1, 1, 3), (1, 2, 3)]


def test_generated_ids_stop_at_the_end_token(spark):
    rows = spark.createDataFrame([([5, 6, 9, 7],), ([5, 6, 7, 8],), ([9, 5],), ([],)],
                                 "ids array<int>")
    got = [r[0] for r in rows.select(S.truncate_at_eos(F.col("ids"), 9, 3)).collect()]
    assert got == [[5, 6], [5, 6, 7], [], []]


def test_extended_inputs(spark):
    row = spark.createDataFrame([([1, 2], [105, 106], [8, 9])],
                                "i array<int>, t array<int>, p array<int>")
    got = row.select(
        S.extend_inputs(F.col("i"), F.col("p"), IDS, "causal"),
        S.extend_types(F.col("t"), F.col("p"), IDS, "causal"),
        S.extend_inputs(F.col("i"), F.col("p"), IDS, "permuted"),
        S.extend_types(F.col("t"), F.col("p"), IDS, "permuted")).first()
    assert list(got) == [[1, 2, 8, 9], [105, 106, 106, 106], [1, 2, 8, 9, IDS.mask],
                         [105, 106, 106, 106, 106]]


def test_settings_are_checked():
    with pytest.raises(ValueError, match="max_hist"):
        CorpusConfig(max_hist=0)


@pytest.mark.parametrize("sf,count", [("0.001", 114), ("0.01", 772), ("0.1", 7024)])
def test_example_counts(spark, sf, count):
    turns = spark.read.parquet(f"/root/testdata/sf{sf}/conversations.parquet")
    assert corpus.text_index(turns, CorpusConfig()).count() == count
