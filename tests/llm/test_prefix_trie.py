"""The trie of conversations against plain sequences."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from colloquy.llm import prefix_trie
from colloquy.llm.prefix_trie import Parentheses

DDL = "conv_id bigint, turn bigint, role string, text string, n_leaves string, depth int"


def brute(rows, history=9, family=5):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % history
        # as SQL does, the remainder has the sign of c
        base = c - (c % family if c >= 0 else -(-c % family))
        full[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
        leaves[node] = leaves.get(node, 0) or 1
        mine = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        saved[node] = saved.get(node, 0) + mine
        if node:
            leaves[node[:-1]] = leaves.get(node[:-1], 0) + leaves[node]
            saved[node[:-1]] = saved.get(node[:-1], 0) + saved[node]
    out = []
    for node, who in members.items():
        ends = sorted(c for c in who if len(full[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who),
                    children.get(node, 0), leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_parentheses(draw, pairs):
    out, depth, left = [], 0, pairs
    while left or depth:
        if left and (not depth or draw.random() < 0.5):
            out, depth, left = out + [True], depth + 1, left - 1
        else:
            out, depth = out + [False], depth - 1
    return np.array(out)


@pytest.mark.parametrize("pairs", [1, 2, 40, 500, 6000])
def test_find_close(pairs):
    draw = random.Random(pairs)
    for opens in (random_parentheses(draw, pairs),
                  np.repeat([True, False], pairs), np.tile([True, False], pairs)):
        want, stack = {}, []
        for at, is_open in enumerate(opens):
            if is_open:
                stack.append(at)
            else:
                want[stack.pop()] = at
        shape = Parentheses(opens)
        at = np.flatnonzero(opens)
        close = shape.find_close(at)
        assert close.tolist() == [want[a] for a in at]
        few = draw.sample(range(len(at)), min(len(at), 50))
        for n in few:
            part = opens[at[n]:close[n] + 1]
            assert shape.leaves(at, close)[n] == (part[:-1] & ~part[1:]).sum()


def test_trie_of_paths():
    def path(*names):
        return np.array([(0, 0, n) for n in names])
    opens, nodes = prefix_trie.trie([path(1, 2, 3), path(1, 2, 4), path(1, 5)])
    assert "".join("()"[not o] for o in opens) == "((()())())"
    assert nodes.tolist() == [0, 1, 2, 5, 7]


def conversations(seed, count=120, length=14):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(3 * count), count):
        n = draw.choice([1, 2, 3, length])
        for turn in range(n):
            rows.append((c, turn, draw.choice(["user", "bot"]),
                         draw.choice(["hi", "yes", "no", "é"])))
    return rows


@pytest.mark.parametrize("segment", [3, 512])
def test_against_sequences(spark, monkeypatch, segment):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    rows = conversations(segment)
    # copies, a prefix of another, nulls, repeated rows, equal turn numbers, negative ids
    rows += [(1000 + c, t, "user", f"t{t}") for c in range(40) for t in range(20)]
    rows += [(1100, t, "user", f"t{t}") for t in range(12)]
    rows += [(1200, None, None, None), (1200, None, None, None), (1200, 1, None, "x"),
             (1200, 2, "a", "bc"), (1200, 3, "ab", "c"), (1200, 3, "ab", "c"),
             (-7, 0, "user", "hi"), (-5, 0, "user", "hi"), (-5, 1, "bot", "hi")]
    rows += [(5000, t, "user", f"long {t % 7}") for t in range(300)]
    rows += [(5001 + k, t, "user", f"long {t % 7}") for k in range(4) for t in range(250)]
    table = spark.createDataFrame(
        [(*r, "x", 1) for r in rows] + [(None, 1, "user", "nobody", "x", 1)], DDL)
    assert rows_of(prefix_trie.prefix_trie(table)) == brute(rows)


def test_equal_turn_numbers(spark):
    """Their order does not hang on how rows are dealt out."""
    rows = [(c, 0, "user", f"t{k * c % 7}", "x", 1) for c in (1, 2, 3) for k in range(12)]
    table = spark.createDataFrame(rows, DDL)
    first = rows_of(prefix_trie.prefix_trie(table.repartition(1)))
    assert first == rows_of(prefix_trie.prefix_trie(table.orderBy("text").repartition(5)))


def test_many_shards(spark):
    """Paths over many partitions and batches: spines are in several shards."""
    rows = conversations(8, 400, 9)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], DDL)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows_of(prefix_trie.prefix_trie(table)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_few(spark):
    one = spark.createDataFrame([(3, 0, "user", "hi", "x", 1)], DDL)
    assert rows_of(prefix_trie.prefix_trie(one)) == brute([(3, 0, "user", "hi")])
    assert prefix_trie.prefix_trie(one.filter("conv_id > 3")).count() == 0
