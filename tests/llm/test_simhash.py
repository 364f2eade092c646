import random
import re

import numpy as np
import pytest
import xxhash

from colloquy.llm import components, simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    label = list(range(len(prints)))
    near = [[j for j, q in enumerate(prints) if (p ^ q).bit_count() <= 2] for p in prints]
    while True:
        new = [min(label[j] for j in js) for js in near]
        if new == label:
            return label
        label = new


TEXTS = [None, "", " \t", "One", "one", "a b", "A B C", "É a b c d", "x " * 50,
         "the quick brown fox jumps over the lazy dog", "q" * 5000]


def test_fingerprints():
    for text in TEXTS:
        assert simhash.fingerprint(text) == brute_print(text), text


def test_long_text_is_counted_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 91}" for i in range(2000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) == whole == brute_print(text)


@pytest.mark.parametrize("cell_rows", [4096, 8])
def test_links_against_all_pairs(spark, monkeypatch, cell_rows):
    """Random fingerprints, flips around them, and a chain; large cells too."""
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:40]:
        for _ in range(6):
            prints.add(p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    chain = rng.getrandbits(64)
    for b in range(0, 60, 2):
        chain ^= 3 << b
        prints.add(chain)
    center = rng.getrandbits(64)
    prints |= {center ^ (1 << b) for b in range(64)} | {0}
    prints = sorted(prints)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    table = spark.createDataFrame([(s,) for s in signed], "fp bigint").repartition(3)
    found = components.components(simhash.links(table)).collect()
    root = {r.node: r.root for r in found}
    got = [root.get(s, s) for s in signed]
    want = brute_classes(prints)
    pairs = {(g, w) for g, w in zip(got, want)}
    assert len(pairs) == len(set(got)) == len(set(want))


def test_classes_of_documents(docs):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(3, long), (9, long + " tail"), (1, "other words here"), (4, None), (2, ""),
            (None, long), (9, long + " tail")]
    got = simhash.near_duplicates(docs(rows)).collect()
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    prints = [brute_print(t) for _, t in rows]
    assert {r.fingerprint for r in got} == {f"{p:016x}" for p in prints}
    assert by[(4, "0" * 16)] == 2 and by[(2, "0" * 16)] == 2
    assert by[(None, f"{prints[0]:016x}")] == 3
    left = simhash.drop_near_copies(docs(rows))
    assert left.columns == docs(rows).columns
    kept = {r.doc_id for r in left.collect()}
    assert {1, 2, 3} <= kept and 4 not in kept and None not in kept


def test_empty_table(docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    assert simhash.drop_near_copies(docs([])).count() == 0


def test_components_of_a_path_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    edges += [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.node: r.root for r in components.components(
        spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)},
                   201: 200, 202: 200}
