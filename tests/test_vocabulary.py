"""Vocabulary, encoding and text evaluation."""

from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from colloquy.config import CorpusConfig
from colloquy.functions import text as X
from colloquy.functions.hashing import config_fingerprint
from colloquy.operators import evaluation as E
from colloquy.operators import vocabulary as V
from colloquy.plans.evaluation import evaluate, export_lines
from colloquy.plans.tables import conversations


def test_vocab_order(spark, turn_table):
    vocab = V.build_vocab(turn_table({1: ["b a b <sp1>", "c a b", ""]}))
    ids = {r.token: r.id for r in vocab.table.collect()}
    assert [t for t, _ in sorted(ids.items(), key=lambda x: x[1])] == [
        "<unk>", "<s>", "</s>", "<mask>", "b", "a", "c",
        "<sp1>", "<sp2>", "<hst>", "<rsp>", "<pad>"]
    assert vocab.size == 12 and vocab.ids.sp1 == 7 and vocab.ids.pad == 11


def test_words_and_unknowns(spark, turn_table):
    known = V.build_vocab(turn_table({1: ["a b"]}))
    rows = turn_table({2: [" a  zzz\tb <sp2>\n", "  ", None]})
    got = {r.turn: r.ids for r in V.encode(rows, known, ["conv_id", "turn"]).collect()}
    assert got == {0: [4, 0, 5, known.ids.sp2], 1: [], 2: []}


def test_repeated_keys_are_refused(spark):
    rows = spark.createDataFrame([(1, 0, "a b"), (1, 0, "c"), (2, 0, ""), (3, 0, "")],
                                 "conv_id bigint, turn bigint, text string")
    vocab = V.build_vocab(rows)
    with pytest.raises(PySparkException, match="several rows"):
        V.encode(rows, vocab, ["conv_id", "turn"]).collect()
    fine = V.encode(rows.where("text <> 'c'"), vocab, ["conv_id", "turn"]).collect()
    assert {r.conv_id: len(r.ids) for r in fine} == {1: 2, 2: 0, 3: 0}


def test_vocabulary_beyond_the_broadcast_bound(spark, sf_dir, monkeypatch):
    rows = conversations(spark, sf_dir)
    keys = ["conv_id", "turn"]
    vocab = V.build_vocab(rows)
    want = sorted(map(tuple, V.encode(rows, vocab, keys).collect()))
    monkeypatch.setattr(V, "BROADCAST_TOKENS", 50)
    monkeypatch.setattr(V, "BROADCAST_TOKEN_BYTES", 5)
    monkeypatch.setattr(V, "HOT_TOKENS", 0)
    assert not vocab.small
    encoded = V.encode(rows, vocab, keys)
    assert sorted(map(tuple, encoded.collect())) == want
    back = {(r.conv_id, r.turn): r.text
            for r in V.decode(encoded, vocab, keys, "ids").collect()}
    for r in rows.collect():
        assert back[r.conv_id, r.turn] == " ".join(r.text.split())


def test_a_hot_long_token_is_not_shuffled(spark, turn_table):
    line = "=" * 200
    rows = turn_table({1: [f"a{i} {line} b{i}" for i in range(90)]})
    vocab = V.build_vocab(rows)
    assert not vocab.small
    hot = vocab.table.where(V._frequent()).where(F.col("token") == line)
    assert hot.count() == 1
    got = V.encode(rows, vocab, ["conv_id", "turn"]).collect()
    assert all(len(r.ids) == 3 and r.ids[1] == 4 for r in got)


def test_counts_match_python(spark, sf_dir):
    rows = conversations(spark, sf_dir)
    want = Counter(w for r in rows.collect() for w in r.text.split())
    got = {r.token: r.n for r in V.build_vocab(rows).table.where("n > 0").collect()}
    assert got == dict(want)


def test_rendered_lines_are_taken_apart(spark):
    row = spark.createDataFrame([("<sp2> hi <sp1> hello",), ("<sp1> a <sp2> b <sp1> c",)],
                                "t string").select(
        X.prompt_of(F.col("t")).alias("p"), X.reply_of(F.col("t")).alias("r")).collect()
    assert [tuple(r) for r in row] == [("hi", " hello"), ("a   b", " c")]


def test_word_vocab_equals_the_words_of_the_examples(spark, sf_dir):
    turns = conversations(spark, sf_dir)
    config = CorpusConfig(max_hist=2, max_len=12)
    table = E.normalized_examples(E.rendered_examples(turns, config)).collect()
    want = set()
    for r in table:
        if r.split in ("train", "test"):
            want |= set(r.input.lower().split())
        if r.split == "test":
            want |= set(r.target.lower().split())
    got = [r.word for r in E.word_vocab(turns, config).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_fingerprint(spark):
    row = spark.range(1).select(config_fingerprint(F.lit(2), F.lit(100000))).first()
    assert row[0] == "48168554"


def test_file_stem(spark):
    row = spark.range(1).select(*[X.file_stem(F.lit(p)) for p in (
        "file:/x/train.json", "/a.b/valid.txt", "test")]).first()
    assert list(row) == ["train", "valid", "test"]


def test_evaluation_exports_aligned_lines(spark, sf_dir, tmp_path):
    turns = conversations(spark, sf_dir)
    config = CorpusConfig(max_len=9)
    keys = ["conv_id", "begin_idx", "end_idx"]
    examples = E.normalized_examples(E.rendered_examples(turns, config))
    said = examples.select(*keys, F.concat(F.lit("Re: "), F.trim("target")).alias("response"))
    result = evaluate(turns, said, config)
    export_lines(result, str(tmp_path / "out"))

    def lines(name):
        return {p.name.split("-")[1]: p.read_text().split("\n")[:-1]
                for p in (tmp_path / "out" / name).glob("part-*")}
    targets, responses = lines("test_target"), lines("test_response")
    assert sum(map(len, targets.values())) == result.table.count() > 0
    for part, rows in targets.items():
        assert ["re: " + t.strip() for t in rows] == responses[part]
    got = {r.metric for r in result.summary.collect()}
    assert got == {"length", "distinct_1", "distinct_2"}
    assert result.train_inputs.count() == examples.where("split = 'train'").count()
