"""Scores against plain arithmetic, and that learning helps on held-out texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import lm_scoring, shards
from colloquy.llm.lm_scoring import CLASSES, ROWS, SLOTS, Tables

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["\n"]


def fold(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def brute_base(rows):
    counts = Counter(t for i, text in rows if not fold(i) for t in tokens(text))
    total, different = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        found = tokens(text)
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (different + 1)))
                   for t in found)
        out.append((str(i), fold(i), len(found), sum(counts[t] > 0 for t in found), total,
                    round(base, 6)))
    return sorted(out)


def base_of(found):
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"],
                   r["train_tokens"], round(r["base_score"], 6)) for r in found)


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = lm_scoring.lm_scores(docs).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert base_of(found) == brute_base(rows)
    held = [r for r in found if r["held_out"]]
    assert len(held) > 5
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    again = lm_scoring.lm_scores(docs).collect()
    assert sorted((r["doc_id"], round(r["score"], 2)) for r in again) == sorted(
        (r["doc_id"], round(r["score"], 2)) for r in found)


@pytest.mark.parametrize("limit", [60, 1 << 20])
def test_awkward(docs, monkeypatch, limit):
    make = shards.blocks
    monkeypatch.setattr(shards, "blocks", lambda b, t: make(b, t, limit))
    rows = [(1, None), (2, ""), (3, "A b C a\tb c"), (None, "a b"), (None, None), (4, "é É 𝄞"),
            (4, "é É 𝄞"), (5, " \n\x0b "), (6, "x" * 5000), (7, "a " * 3000), (8, "last\r\nline")]
    rows += [(10 + i, f"word{i % 3} a b c") for i in range(60)]
    found = lm_scoring.lm_scores(docs(rows)).collect()
    assert base_of(found) == brute_base(rows)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)


def test_nothing_to_learn_from(docs):
    assert lm_scoring.lm_scores(docs([])).count() == 0
    held = next(i for i in range(100) if fold(i))
    row = lm_scoring.lm_scores(docs([(held, "a b")])).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0)
    assert abs(row["base_score"]) < 1e-9 and abs(row["score"]) < 1e-6


def test_untrained_model_is_the_base(docs):
    rows = [(i, f"one two{i % 5} three{i % 7} one") for i in range(50)]
    found = lm_scoring.lm_scores(docs(rows), rounds=0).collect()
    assert all(abs(r["score"] - r["base_score"]) < 1e-3 for r in found)


def example(seed):
    draw = np.random.default_rng(seed)
    tables = Tables(draw.random((CLASSES, SLOTS)))
    tables.classes[:] += draw.normal(0, 0.3, tables.classes.shape)
    tables.slots[:] += draw.normal(0, 0.3, tables.slots.shape)
    words = draw.integers(0, 1 << 62, 40).astype(np.uint64)
    starts = np.array([0, 1, 17, 30])
    return tables, words, starts, draw.integers(0, CLASSES * SLOTS, 40)


def plain_chances(tables, words, starts, at):
    """Chances of all slots for the token at a place, by plain sums."""
    start = max(s for s in starts if s <= at)
    one = words[at - 1] if at - start >= 1 else np.uint64(0)
    two = words[at - 2] if at - start >= 2 else np.uint64(0)
    mix = lambda v: lm_scoring.mixed(np.array([v], np.uint64))[0]
    kinds = [mix(one ^ np.uint64(1)), mix(mix(one ^ np.uint64(2)) ^ two),
             mix(two ^ np.uint64(3))]
    logits = tables.classes[ROWS].astype(float)
    for k in kinds:
        logits = logits + tables.classes[int(k) % ROWS]
    first = np.exp(logits) / np.exp(logits).sum()
    out = np.empty((CLASSES, SLOTS))
    for c in range(CLASSES):
        logits = tables.slots[ROWS + c].astype(float)
        for k in kinds:
            logits = logits + tables.slots[
                ((int(k) >> 20) + c * 0x632BE5AB) % 2**64 % ROWS]
        out[c] = first[c] * np.exp(logits) / np.exp(logits).sum()
    assert abs(out.sum() - 1) < 1e-6
    return out.ravel()


def test_chances_against_plain_sums():
    tables, words, starts, slots = example(3)
    found = lm_scoring.features(words, starts)
    got = lm_scoring.log_chances(tables, found, slots)
    for at in range(len(words)):
        want = math.log(plain_chances(tables, words, starts, at)[slots[at]])
        assert abs(got[at] - want) < 1e-4


def test_gradient_against_differences():
    """A step moves each used weight against the slope of the loss."""
    tables, words, starts, slots = example(4)
    rows, _ = lm_scoring.rows_of(lm_scoring.features(words, starts), slots // SLOTS)
    rows, target = rows[:1], slots // SLOTS  # a single feature: rows move once

    def loss(table):
        chances = np.exp(lm_scoring.weights(table.astype(np.float64), rows))
        chances /= chances.sum(axis=1, keepdims=True)
        return -np.log(chances[np.arange(len(target)), target]).sum()

    before = tables.classes.copy()
    seen = np.ones(len(before), np.float32)
    lm_scoring._step(tables.classes, seen, rows, target)
    moved = tables.classes - before
    for row in np.unique(rows)[:5]:
        for column in (0, 7, int(target[rows[0] == row][0])):
            step = np.zeros(before.shape, np.float64)
            step[row, column] = 1e-3
            slope = (loss(before + step) - loss(before - step)) / 2e-3
            assert abs(-moved[row, column] * math.sqrt(seen[row]) / lm_scoring.RATE - slope) < 2e-3
    assert loss(tables.classes) < loss(before)
