"""Phrases and their counts against plain counting."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from colloquy.llm import collocations, shards

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def brute(rows, max_words=3, min_count=10, top=2000):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            total[lang] += len(words)
            for size in range(1, max_words + 1):
                for at in range(len(words) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(words[at:at + size])] += 1
    out = []
    for lang, found in counts.items():
        often = {p: a for p, a in found.items() if len(p) > 1 and a >= min_count}
        gone = set()
        for p, a in often.items():
            for start in range(len(p)):
                for end in range(start + 2, len(p) + 1):
                    part = p[start:end]
                    if part != p and 100 * a >= 50 * found[part]:
                        gone.add(part)
        kept = []
        for p, a in often.items():
            if p in gone:
                continue
            cuts = [(10**6 * a * a // (found[p[:k]] * found[p[k:]]), k,
                     found[p[:k]], found[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        kept.sort()
        out += [(lang, n + 1, p.decode(), -a, left, right, total[lang], -score)
                for n, (score, a, p, left, right) in enumerate(kept[:top])]
    return sorted(out)


def rows_of(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"],
                   r["score"]) for r in df.collect())


@pytest.mark.parametrize("depth", [2, 3, 4, 5])
def test_intervals_count_every_phrase(depth):
    draw = random.Random(depth)
    for size in (1, 2, 7, 60, 500):
        text = [draw.choice([0, 1, 1, 2, 3, 9]) for _ in range(size)]
        want = Counter()
        for length in range(2, depth + 1):
            for at in range(size - length + 1):
                if 0 not in text[at:at + length]:
                    want[tuple(text[at:at + length])] += 1
        got = {}
        for words, counts in collocations.phrase_counts(np.array(text, np.int64), depth):
            assert len(words) == len(counts)
            got.update({tuple(w): c for w, c in zip(words.tolist(), counts.tolist())})
        assert got == want


def test_wide_rows_are_ordered_alike():
    draw = np.random.default_rng(3)
    columns = [draw.integers(0, 5, 400) << 40 for _ in range(3)]
    assert (collocations.row_order(columns)
            == collocations.row_order([c >> 40 for c in columns])).all()


def awkward():
    draw = random.Random(5)
    words = ["New", "york", "CITY", "é", "Éa", "a", "b", "the", "x\x1cy", "don't"]
    rows = [(None, "en"), ("", "en"), ("a", None), (" \t .,;", "de"), ("New York City " * 300, "en")]
    for _ in range(300):
        lang = draw.choice(["en", "en", "en", "de", None, "und"])
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", ". ", "\t", "\n", ",", "\r"])
                       for _ in range(draw.randrange(60)))
        rows += [(text, lang)] * draw.choice([1, 1, 1, 20])
    return rows


@pytest.mark.parametrize("limit", [300, 1 << 20])
def test_against_counting(docs, monkeypatch, limit):
    """With shards of a few texts, over several rounds, and with large ones."""
    make = shards.blocks
    monkeypatch.setattr(shards, "blocks", lambda b, t: make(b, t, limit))
    if limit == 300:
        monkeypatch.setattr(collocations, "FAN", 4)
    rows = awkward()
    table = docs([(i, text, lang) for i, (text, lang) in enumerate(rows)])
    assert rows_of(collocations.collocations(table)) == brute(rows)
    assert rows_of(collocations.collocations(table, 4, 7, top=9)) == brute(rows, 4, 7, 9)


def test_extensions(docs):
    table = docs([(1, "a b c. a b c. a b d. z b c.", "en")] * 3)
    _, words, found = collocations.phrases(table, 3, 1)
    names = {r["id"]: bytes(r["word"]).decode() for r in words.collect()}
    got = {tuple(names[i] for i in r["ids"]): (r["left_n"], r["right_n"])
           for r in collocations.longer_counts(found).collect()}
    assert got == {("a", "b"): (None, 6), ("b", "c"): (6, None), ("b", "d"): (3, None),
                   ("z", "b"): (None, 3)}


def test_large_counts(spark):
    """Products beyond 64 bits."""
    words = spark.createDataFrame([(1, 5 * 10**12), (2, 7 * 10**12)], "id bigint, n bigint")
    found = spark.createDataFrame([([1, 2], 3 * 10**12 + 1)], "ids array<bigint>, n bigint")
    row = collocations.scored(words, found).first()
    assert row["score"] == 10**6 * (3 * 10**12 + 1)**2 // (35 * 10**24)


def test_nothing(docs):
    assert collocations.collocations(docs([])).count() == 0
    assert collocations.collocations(docs([(1, None), (2, ""), (3, "a b")])).count() == 0


class Handed:
    """Hands out the function that an operator gives to Spark."""

    def groupBy(self, *names):
        return self

    def cogroup(self, other):
        return self

    def applyInArrow(self, make, ddl):
        return make


def totals(parts):
    out = Counter()
    for words, counts in parts:
        for phrase, n in zip(words.tolist(), counts.tolist()):
            out[tuple(phrase)] += n
    return out


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 499, 500, 501])
def test_blocks_add_up(monkeypatch, block):
    """No phrase across a seam is lost or counted twice, breaks or none."""
    monkeypatch.setattr(collocations, "BLOCK", block)
    draw = random.Random(block)
    for symbols in ([0, 1, 1, 2, 3, 9], [1], [1, 2]):
        text = np.array([draw.choice(symbols) for _ in range(500)], np.int32)
        for depth in (2, 3, 5):
            assert (totals(collocations.block_counts(text, depth))
                    == totals(collocations.phrase_counts(text, depth)))


def test_indexing_a_shard_is_bounded_in_memory():
    """All arrays of one shard; 78 bytes a symbol when it was indexed whole, 20 in blocks."""
    draw = np.random.default_rng(1)
    size, known = 1_500_000, 60_000
    text = np.minimum(draw.zipf(1.3, size), known).astype(np.int32)
    text[draw.random(size) < 0.15] = 0
    texts = pa.table({"shard": [0], "run": [0], "n": [size], "symbols": [shards.pack(text)]})
    words = pa.table({"local": np.arange(1, known + 1), "id": np.arange(1, known + 1) * 7})
    make = collocations.phrase_runs(Handed(), Handed(), 3)
    tracemalloc.start()
    try:
        found = make((0,), texts, words)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    got = [collocations._opened(*row) for row in zip(*[
        found[name].to_pylist() for name in ("size", "entries", "packed")])]
    inner = (text[:-1] > 0) & (text[1:] > 0)
    assert sum(int(n.sum()) for ids, n in got if len(ids) == 2) == inner.sum()
    assert (sum(int(n.sum()) for ids, n in got if len(ids) == 3)
            == (inner[:-1] & inner[1:]).sum())
    assert peak < 40 * size


def test_words_cut_out_slice_by_slice(monkeypatch):
    texts = [text for text, _ in awkward()][:120] + [None, "", "..", "a. b"]
    table = shards.kinds(collocations.BLANKS, collocations.CUTS)
    want = []
    for text in texts:
        want += [[w.encode() for w in piece] for piece in pieces(text) if piece]
    for limit in (1, 50, 1 << 20):
        monkeypatch.setattr(collocations, "SLICE_BYTES", limit)
        known, symbols = collocations.coded(pa.table({"text": pa.array(texts)}), table)
        names = known.to_pylist()
        assert len(set(names)) == len(names)
        got = []
        for symbol in symbols.tolist():
            if symbol:
                got[-1].append(names[symbol - 1])
            else:
                got.append([])
        assert got == want


@pytest.mark.parametrize("most, rounds", [(2, range(2, 9)), (64, range(1, 2))])
def test_runs_meet_in_one_round(docs, monkeypatch, most, rounds):
    """Parts grow with the runs, so phrases are exchanged once; beyond the bound, again."""
    monkeypatch.setattr(collocations, "FAN", 2)
    monkeypatch.setattr(collocations, "FAN_MOST", most)
    made, merge = [], collocations.merge_round
    monkeypatch.setattr(collocations, "merge_round",
                        lambda *a: made.append(a) or merge(*a))
    rows = awkward()
    table = docs([(i, text, lang) for i, (text, lang) in enumerate(rows)]).repartition(8)
    assert rows_of(collocations.collocations(table)) == brute(rows)
    assert len(made) in rounds


def test_fan_follows_the_runs():
    assert [collocations.fan_of(n) for n in (0, 1, 128, 129, 256, 5000, 10**6)] == [
        128, 128, 128, 256, 256, 8192, 8192]


@pytest.mark.parametrize("depth", [3, 4, 5])
def test_texts_without_breaks(depth):
    """The end of a text is not taken for its smallest suffix."""
    for text in ([2, 1, 1, 2, 1, 2, 1], [1, 2, 1, 2, 1, 1], [1] * 6, [1, 2, 1]):
        want = Counter(tuple(text[at:at + n]) for n in range(2, depth + 1)
                       for at in range(len(text) - n + 1))
        assert totals(collocations.phrase_counts(np.array(text), depth)) == want
