import itertools
import random

import numpy as np
import pytest

from colloquy.llm import chat_format as cf

DDL = "conv_id bigint, turn bigint, role string, text string, cost string, given string"


@pytest.fixture
def turns(spark):
    def build(rows):
        return spark.createDataFrame([(*r, "x", "y") for r in rows], DDL)
    return build


def legal(roles):
    roles = list(roles)
    if roles[:1] == ["system"]:
        roles = roles[1:]
    return bool(roles) and roles == ["user", "assistant"] * (len(roles) // 2)


def cheapest(given):
    """Least cost by trying every role and every way to place each turn."""
    best = None
    for roles in itertools.product(("system", "user", "assistant"), repeat=len(given)):
        for ways in itertools.product((0, 1, 2), repeat=len(given)):
            made, cost, fine = [], 0, True
            for old, role, way in zip(given, roles, ways):
                if old != role:
                    cost += cf.RELABEL if old in cf.ROLES else cf.UNKNOWN
                if way == 1:
                    fine &= bool(made) and made[-1] == role
                    cost += cf.MERGE
                else:
                    if way == 2:
                        made.append("assistant" if role == "user" else "user")
                        cost += cf.INSERT
                    made.append(role)
            if not fine:
                continue
            for tail in ((), ("assistant",), ("user", "assistant")):
                if legal(made + list(tail)) and (best is None
                                                 or cost + cf.INSERT * len(tail) < best):
                    best = cost + cf.INSERT * len(tail)
    return best


def test_costs_against_all_ways(turns):
    rng = random.Random(4)
    names = ["system", "user", "assistant", None, "tool"]
    convs = [[rng.choice(names) for _ in range(rng.randrange(1, 5))] for _ in range(30)]
    convs += [["user", "assistant"], ["system", "user", "assistant"], ["user"], ["assistant"]]
    rows = [(c, t, role, f"t{t}") for c, roles in enumerate(convs)
            for t, role in enumerate(roles)]
    found = {}
    for r in cf.repaired(turns(rows)).orderBy("place").collect():
        found.setdefault(r.conv_id, []).append(r)
    for c, roles in enumerate(convs):
        assert sum(r.cost for r in found[c]) == cheapest(roles), roles
        whole = "".join(r.rendered for r in found[c])
        parts = whole.split("<|im_end|>\n")
        assert parts.pop() == ""
        assert all(p.startswith("<|im_start|>") for p in parts)
        assert legal([p[12:].split("\n")[0] for p in parts]), whole
        assert all(f"t{t}" in whole for t in range(len(roles)))


def test_a_long_conversation_over_many_ranges(turns, spark):
    rng = random.Random(6)
    rows = [(1 if i < 1500 else i // 5, i, rng.choice(["user", "assistant", "system", None]),
             f"t{i}") for i in range(3000)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = cf.repaired(turns(rows).repartition(6)).orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len({r.place >> 33 for r in got if r.conv_id == 1}) > 1
    found = {}
    for r in got:
        found.setdefault(r.conv_id, []).append(r)
    for conv, out in found.items():
        given = np.array([cf.NAMES.index(r.role) if r.role else 0 for r in out])
        assert [r.turn for r in out] == sorted(r.turn for r in out)
        values = cf.forward(given, np.array([0, cf.FAR, cf.FAR, cf.FAR]))
        total = values[-1] + cf.FINAL
        states = cf.backward(given, values, int(np.argmin(total)))
        assert [r.new_role for r in out] == [cf.NAMES[s] for s in states[1:]], conv
        assert sum(r.cost for r in out) == total.min()


def test_awkward_rows(turns):
    rows = [(None, 1, "user", "a"), (None, None, "user", None), (2, 0, None, None),
            (3, 0, "user", "q"), (3, 0, "user", "q"), (3, 1, "assistant", "")]
    got = cf.repaired(turns(rows)).collect()
    assert len(got) == len(rows)
    assert [r.action for r in got if r.conv_id == 3].count("merge") == 1
    assert {r.turn for r in got if r.conv_id is None} == {1, None}
    assert cf.repaired(turns([])).count() == 0


def test_rendering(turns):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "there"), (1, 2, "assistant", "bye"),
            (2, 0, "assistant", "hello"), (2, 1, "user", "well")]
    whole = {}
    for r in cf.repaired(turns(rows)).orderBy("place").collect():
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.rendered
    empty = "<|im_start|>{}\n<|im_end|>\n"
    assert whole[1] == ("<|im_start|>user\nhi\nthere<|im_end|>\n"
                        "<|im_start|>assistant\nbye<|im_end|>\n")
    assert whole[2] in (
        empty.format("user") + "<|im_start|>assistant\nhello<|im_end|>\n"
        "<|im_start|>user\nwell<|im_end|>\n" + empty.format("assistant"),
        "<|im_start|>user\nhello<|im_end|>\n<|im_start|>assistant\nwell<|im_end|>\n")
