"""Readers, writers, corpus preparation and streams."""

import json

import pytest
from pyspark.sql import functions as F

from colloquy import session
from colloquy.config import CorpusConfig
from colloquy.operators import batching as B
from colloquy.operators import metrics as M
from colloquy.operators import splits as P
from colloquy.operators import turns as T
from colloquy.plans import corpus
from colloquy.plans.tables import conversations
from colloquy.sources import SOURCES, read_source, readers, register_source, writers


def dialogs(turns):
    """{split: sorted list of dialogues}."""
    by_id = {}
    for r in turns.collect():
        by_id.setdefault((r.split, r.conv_id), {})[r.turn] = r.text
    out = {}
    for (split, _), texts in by_id.items():
        assert sorted(texts) == list(range(len(texts)))
        out.setdefault(split, []).append([texts[t] for t in sorted(texts)])
    return {s: sorted(d) for s, d in out.items()}


def test_jsonl(spark, tmp_path):
    for name, lines in {"train": [["a", "b"], ["c", "d", "e"]], "test": [["x", "y"]]}.items():
        (tmp_path / f"{name}.json").write_text("\n".join(
            json.dumps({"topic": 1, "dialogue": [{"text": t, "act": 2} for t in d]})
            for d in lines) + "\n")
    got = dialogs(read_source(spark, "jsonl", str(tmp_path)))
    assert got == {"train": [["a", "b"], ["c", "d", "e"]], "test": [["x", "y"]]}


def test_nested_json(spark, tmp_path):
    def entry(history, candidates):
        return {"history": history, "candidates": candidates}
    doc = {"train": [{"personality": ["p"], "utterances": [
        entry(["a"], ["no", "b"]), entry(["a", "b", "c"], ["no", "d"])]}],
        "valid": [{"utterances": [entry(["v"], ["w"])]}]}
    (tmp_path / "corpus.json").write_text(json.dumps(doc, indent=2))
    got = dialogs(read_source(spark, "personachat", str(tmp_path)))
    assert got == {"train": [["a", "b", "c", "d"]], "valid": [["v", "w"]],
                   "test": [["v", "w"]]}


@pytest.mark.parametrize("source,name,text", [
    ("jsonl", "train.json", '{"dialogue": [{"text": "a"}]}\n{"dialogue": [{"te'),
    ("jsonl", "train.json", '{"other": 1}\n'),
    ("jsonl", "other.json", '{"dialogue": [{"text": "a"}]}\n'),
    ("nested_json", "c.json", '{"train": [{"utterances": [{"history": ["a"], "cand'),
    ("nested_json", "c.json", '{"train": [{"utterances": [{"history": ["a"], '
                              '"candidates": []}]}], "valid": []}'),
    ("map_json", "train.json", '{"a": {"content": [{"mess'),
    ("map_json", "train.json", '{"a": {"config": 1}}'),
    ("blankline_text", "trainer.txt", "a\nb\n"),
])
def test_broken_input_fails_the_read(spark, tmp_path, source, name, text):
    (tmp_path / name).write_text(text)
    with pytest.raises(Exception, match="(?i)no split|dialogue|malformed|no document"):
        read_source(spark, source, str(tmp_path)).collect()


def test_many_files_per_split(spark, tmp_path):
    line = '{"dialogue": [{"text": "%s"}, {"text": "x"}]}\n'
    for name, text in {"train-00000.json": "a", "train-00001.json": "b", "valid_0.json": "c",
                       "test/part-7.json": "d"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(line % text)
    got = dialogs(readers.read_jsonl(spark.newSession(), f"{tmp_path}/*"))
    assert got == {"train": [["a", "x"], ["b", "x"]], "valid": [["c", "x"]],
                   "test": [["d", "x"]]}


@pytest.mark.parametrize("name,write", [
    ("jsonl", writers.write_jsonl), ("nested_json", writers.write_nested_json),
    ("map_json", writers.write_map_json), ("blankline_text", writers.write_blankline_text)])
def test_a_long_conversation_comes_back_whole(spark, turn_table, tmp_path, name, write):
    long = [f"t{i}" for i in range(600)]
    turns = turn_table({10: long, 21: ["a", "b"]}).withColumn("split", F.lit("train"))
    write(turns, str(tmp_path / "out"))
    got = dialogs(read_source(spark, name, str(tmp_path / "out")))
    assert got == {"train": sorted([long, ["a", "b"]])}


def test_keyed_dialogues_have_the_same_ids_in_each_read(spark, tmp_path):
    doc = {f"k{i}": {"content": [{"message": f"m{i}"}]} for i in range(50)}
    (tmp_path / "train.json").write_text(json.dumps(doc))
    read = lambda: sorted(
        (r.conv_id, r.text) for r in readers.read_map_json(spark, str(tmp_path)).collect())
    assert read() == read() and len({c for c, _ in read()}) == 50


def test_map_json_prefers_frequent(spark, tmp_path):
    def doc(**kv):
        return json.dumps({k: {"config": "A", "content": [{"message": m, "agent": "x"}
                                                          for m in v]} for k, v in kv.items()})
    (tmp_path / "train.json").write_text(doc(t=["1", "2"]))
    (tmp_path / "valid_rare.json").write_text(doc(a=["1"], b=["2"]))
    (tmp_path / "valid_freq.json").write_text(doc(b=["3"], c=["4"]))
    (tmp_path / "test_rare.json").write_text(doc(z=["9"]))
    got = dialogs(read_source(spark, "map_json", str(tmp_path)))
    assert got == {"train": [["1", "2"]], "valid": [["1"], ["3"], ["4"]], "test": [["9"]]}


@pytest.mark.parametrize("text,want", [
    ("a\nb\n\nc\nd", [["a", "b"], ["c", "d"]]),
    ("a\nb\n\n\n\n c \nd\n\n", [["a", "b"], ["c", "d"]]),
    ("a\n \t\nb\n \nc", [["a"], ["b"], ["c"]]),
    ("a\r\nb\r\n\r\nc\r\n", [["a", "b"], ["c"]]),
    ("\n\na", [["a"]]),
])
def test_blankline_text(spark, tmp_path, text, want):
    (tmp_path / "train.txt").write_bytes(text.encode())
    got = dialogs(read_source(spark, "blankline_text", str(tmp_path)))
    assert got == {"train": want}


def test_sources_are_pluggable(spark):
    def numbers(spark, path):
        return spark.range(3).select(F.lit(path).alias("split"), F.lit(1).alias("conv_id"),
                                     F.col("id").alias("turn"), F.lit("x").alias("text"))
    register_source("numbers", numbers)
    assert read_source(spark, "numbers", "p").count() == 3
    del SOURCES["numbers"]
    with pytest.raises(ValueError, match="source"):
        read_source(spark, "numbers", "p")


def test_metric_text(spark, tmp_path):
    (tmp_path / "m.txt").write_text("label m1 m2\nlabel 1.5,0.5,0.1 2,3,4\n")
    got = [tuple(r) for r in readers.read_metric_text(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("m1", 1.5, 0.5, 0.1), ("m2", 2.0, 3.0, 4.0)]


def test_history_file(spark, tmp_path):
    columns = {h: [i + n / 10 for i in range(2)] for n, h in enumerate(M.HISTORY[1:])}
    (tmp_path / "history.json").write_text(json.dumps({"epoch": [0, 1], **columns}))
    rows = readers.read_history(spark, str(tmp_path)).orderBy("epoch").collect()
    assert [r.epoch for r in rows] == [0, 1]
    assert [r.valid_ppl for r in rows] == [0.5, 1.5]


def test_shards_are_written_in_order(spark, sf_dir, tmp_path):
    turns = conversations(spark, sf_dir)
    layout = B.dialog_layout(turns, CorpusConfig(file_size=6))
    rows = turns.join(layout.select("conv_id", "split", "shard"), "conv_id")
    path = str(tmp_path / "out")
    writers.write_shards(rows, path)
    assert sorted(p.name for p in (tmp_path / "out").glob("split=*")) == [
        "split=test", "split=train", "split=valid"]
    assert spark.read.parquet(path).count() == turns.count()
    # 16 training conversations in shards of 6
    sizes = [readers.scan_split(spark, path, "train", n).select("conv_id").distinct().count()
             for n in range(4)]
    assert sizes == [6, 6, 4, 0]
    plan = readers.scan_split(spark, path, "valid")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_merge_precedence(spark, turn_table):
    rare = turn_table({1: ["1"], 2: ["2", "2b"]})
    freq = turn_table({2: ["3"], 3: ["4"]})
    got = sorted(map(tuple, P.merge_precedence(rare, freq).collect()))
    assert got == [(1, 0, "1"), (2, 0, "3"), (3, 0, "4")]


def test_overlap_counts_copies_once(spark, turn_table):
    # ids 0-7 train, 8 valid, 9 test
    turns = T.with_split(turn_table({0: ["a", "b"], 1: ["a", "b"], 8: ["a", "b"],
                                     9: ["b", "a"]}))
    found = P.split_overlap(T.with_split(P.dialog_digest(turns)), F.col("digest"))
    got = {r.split: (r.n_items, r.n_shared) for r in found.collect()}
    assert got == {"train": (1, 1), "valid": (1, 1), "test": (1, 0)}


def test_corpus_is_built_once(spark, sf_dir, tmp_path, monkeypatch):
    turns = conversations(spark, sf_dir)
    config = CorpusConfig(max_len=8, batch_size=4)
    first = corpus.prepare_corpus(spark, turns, "", str(tmp_path), config)
    want = sorted(map(tuple, corpus.text_examples(turns, config).collect()))
    assert sorted(map(tuple, first.examples().collect())) == want
    assert {r.split: r.n_dialogs for r in first.manifest.collect()} == {
        "train": 16, "valid": 2, "test": 2}

    def fail(*_):
        raise AssertionError("rebuilt")
    monkeypatch.setattr(corpus, "build_vocab", fail)
    again = corpus.prepare_corpus(spark, turns, "", str(tmp_path), config)
    assert again.index().count() == len(want) == 114
    assert again.batches("causal").count() == 114
    # a rebuild that fails leaves the corpus as it was
    with pytest.raises(AssertionError, match="rebuilt"):
        corpus.prepare_corpus(spark, turns, "", str(tmp_path), config, force_rebuild=True)
    left = corpus.prepare_corpus(spark, turns, "", str(tmp_path), config)
    assert sorted(map(tuple, left.examples().collect())) == want


def test_sources_never_meet_in_one_folder(spark, turn_table, tmp_path):
    made = {}
    for word in ("alpha", "beta"):
        table = turn_table({1: [f"{word}{i}" for i in range(3)]})
        made[word] = corpus.prepare_corpus(spark, table, "", str(tmp_path / "data"))
    for word, found in made.items():
        words = {r.token for r in found.vocab.table.collect()}
        assert {f"{word}{i}" for i in range(3)} <= words
        assert not any(w.startswith("alpha" if word == "beta" else "beta") for w in words)
    raw = tmp_path / "raw"
    raw.mkdir()
    for text in ("one\ntwo\n", "three\nfour\nfive\n"):
        (raw / "train.txt").write_text(text)
        found = corpus.prepare_corpus(spark, "blankline_text", str(raw), str(tmp_path / "data"))
        assert found.turns.count() == text.count("\n")


def test_a_lost_file_is_noticed(spark, turn_table, tmp_path):
    table = turn_table({1: ["a", "b"], 9: ["c", "d"]})
    corpus.prepare_corpus(spark, table, "", str(tmp_path))
    next(tmp_path.rglob("turns/split=test/shard=0/*.parquet")).unlink()
    with pytest.raises(ValueError, match="list of files"):
        corpus.prepare_corpus(spark, table, "", str(tmp_path))


def test_corpus_from_files_keeps_their_splits(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for split in ("train", "valid", "test"):
        (raw / f"{split}.txt").write_text("hello there\nhi\nbye now\n\nyes\nno\n")
    made = corpus.prepare_corpus(spark, "blankline_text", str(raw), str(tmp_path / "data"))
    got = {r.split: (r.n_dialogs, r.n_examples) for r in made.manifest.collect()}
    assert got == {s: (2, 4) for s in ("train", "valid", "test")}
    batch = made.batches("permuted").collect()
    assert {r.split for r in batch} == {"train", "valid", "test"} and len(batch) == 12


def test_ranks_and_masks_of_a_corpus(spark, sf_dir, tmp_path):
    turns = conversations(spark, sf_dir)
    made = corpus.prepare_corpus(spark, turns, "", str(tmp_path),
                                 CorpusConfig(batch_size=4, world_size=2, max_len=6))
    key = lambda r: (r.conv_id, r.begin_idx, r.end_idx)
    everything = {key(r) for r in made.batches().collect()}
    parts = [made.batches("permuted", rank=r, masks=True).collect() for r in range(2)]
    assert len(parts[0]) == len(parts[1])
    assert {key(r) for part in parts for r in part} == everything
    row = parts[0][0]
    assert len(row.perm_mask) == row.max_seq and len(row.target_map) == row.max_target
    with pytest.raises(ValueError, match="rank"):
        made.batches(rank=2)
    with pytest.raises(ValueError, match="masks"):
        made.batches("causal", masks=True)


def test_staged_tables_can_be_removed(spark):
    path = session.staging_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert session.remove_staged(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    assert session.remove_staged(spark) == 0


def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    folder = session.shared_dir(spark)
    assert session.staging_path(spark, "x").startswith(folder)
