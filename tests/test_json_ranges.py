"""Large JSON documents in small ranges give what the whole gives."""

import json
import random
import tracemalloc

import pyarrow as pa
import pytest

from colloquy.sources import json_ranges, readers

NASTY = ['plain', 'a "quoted" }{', '\\', '\\\\"', 'é𝄞 ü', '}', '{[', '"', ' ', '\n\t]', '}' * 30,
         'long ' * 20, '}{"train": [']


def dialogs_of(rows):
    found = {}
    for r in rows:
        found.setdefault((r.split, r.conv_id), []).append((r.turn, r.text))
    return sorted((split, [t for _, t in sorted(turns)]) for (split, _), turns in found.items())


@pytest.fixture(params=[64, 1 << 20])
def ranged(spark, request):
    """Files are cut into ranges of so many bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": str(request.param),
            "spark.sql.files.openCostInBytes": "1",
            "spark.sql.files.minPartitionNum": "1"}
    for key, value in keys.items():
        spark.conf.set(key, value)
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    for key in keys:
        spark.conf.unset(key)


def talk(draw):
    return [draw.choice(NASTY) for _ in range(draw.randrange(2, 6))]


@pytest.mark.parametrize("indent", [None, 2])
def test_nested(ranged, tmp_path, indent):
    draw = random.Random(indent or 0)
    parts = {n: [talk(draw) for _ in range(k)] for n, k in (("train", 3), ("valid", 2))}
    doc = {"meta": {"n": 1, "odd": [[{"train": "}"}]]}} if indent else {}
    for name, dialogs in parts.items():
        doc[name] = [{"personality": ["x}"], "utterances": [
            {"history": d[:1], "candidates": ["no"]},
            {"candidates": ["wrong", d[-1]], "history": d[:-1]}]} for d in dialogs]
        doc[f"after {name}"] = [1, "["]
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=bool(indent)))
    got = dialogs_of(readers.read_nested_json(ranged, str(tmp_path)).collect())
    want = [(split, d) for split, name in (("train", "train"), ("valid", "valid"),
                                           ("test", "valid")) for d in parts[name]]
    assert got == sorted(want)


def test_map(ranged, tmp_path):
    draw = random.Random(4)
    want = []
    for split in ("train", "valid_freq", "test_rare"):
        doc = {}
        for n in range(3):
            talked = talk(draw)
            doc[f'k{n}" }}{draw.choice(NASTY)}'] = {
                "config": {"a": {"b": "}"}}, "content": [{"message": t, "agent": "x"}
                                                         for t in talked]}
            want.append((split.split("_")[0], talked))
        (tmp_path / f"{split}.json").write_text(
            json.dumps(doc, ensure_ascii=False) + " \n" * (split == "train"))
    (tmp_path / "train_rare.json").write_text("{}")
    assert dialogs_of(readers.read_map_json(ranged, str(tmp_path)).collect()) == sorted(want)


def test_ranges_are_read_apart(spark, tmp_path):
    """A document goes to many tasks, and empty lists are documents too."""
    talked = [{"utterances": [{"history": ["a" * 40], "candidates": ["b"]}]}] * 200
    (tmp_path / "c.json").write_text(json.dumps({"valid": [], "train": talked}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = json_ranges.pieces(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 5
        assert readers.read_nested_json(spark, str(tmp_path)).count() == 400
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("text", [
    '{"train": [], "valid": []', '{"train": [{"utterances": []}{"utterances": []}], "valid": []}',
    '{"train": [{"utterances": [{"history": ["a"], "candidates": ["b"]}]}], "valid": [}',
    '{"train": []}', '{"train": [{"utterances": 3}], "valid": []}'])
def test_broken_documents(spark, tmp_path, text):
    (tmp_path / "c.json").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed|document|comma|dialogue"):
        readers.read_nested_json(spark, str(tmp_path)).collect()


def _batch(dialogs, inside=0, depth=0):
    pieces = json.dumps({"train": dialogs, "valid": []}, ensure_ascii=False).split("}")[:-1]
    n = len(pieces)
    return pa.RecordBatch.from_pydict({
        "file": ["f"] * n, "start": [0] * n, "full": [9] * n, "value": pieces,
        "inside": [inside] * n, "depth": [depth] * n})


def test_runs_are_cut_by_bytes(monkeypatch):
    """However many bytes a batch has, a range's pieces come out the same."""
    draw = random.Random(5)
    batch = _batch([{"utterances": [{"history": talk(draw), "candidates": ["x"]}]}
                    for _ in range(60)])
    whole = pa.Table.from_batches(json_ranges._marker(3)(iter([batch]))).to_pydict()
    effect = pa.Table.from_batches(json_ranges.effects(iter([batch]))).to_pylist()
    assert len(effect) == 1
    monkeypatch.setattr(json_ranges, "RUN_BYTES", 100)
    parts = pa.Table.from_batches(json_ranges._marker(3)(iter([batch]))).to_pydict()
    for name in ("place", "ended", "head", "body", "closes", "inherits"):
        assert parts[name] == whole[name], name
    effects = pa.Table.from_batches(json_ranges.effects(iter([batch]))).to_pylist()
    assert len(effects) > 20 and sum(e["bytes"] for e in effects) == effect[0]["bytes"]
    turned = deeper = 0
    for e in effects:
        deeper += e["deeper1" if turned else "deeper0"]
        turned ^= e["turned"]
    assert (turned, deeper) == (effect[0]["turned"], effect[0]["deeper0"])


def test_memory_does_not_grow_with_a_batch():
    batch = _batch([{"utterances": [{"history": ["word " * 400], "candidates": ["x"]}]}] * 5000)
    for work in (json_ranges.effects, json_ranges._marker(3)):
        tracemalloc.start()
        for _ in work(iter([batch])):
            pass
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
        tracemalloc.stop()
