import pytest

from colloquy.llm import mixing


def table(docs, sizes):
    """``{source: [size, ...]}`` as documents."""
    rows, n = [], 0
    for source, each in sizes.items():
        for size in each:
            rows.append((n, " ".join(["w"] * size), "en", source))
            n += 1
    return docs(rows)


def shares(sizes, weights=(5, 2, 1), most=3):
    """Targets by cutting off the largest excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, cut = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in cut]
        left = total - sum(most * sizes[s] for s in cut)
        out = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if out[s] > most * sizes[s]}
        if not over:
            return {**out, **{s: float(most * sizes[s]) for s in cut}}
        cut |= over


def test_targets_and_words_taken(docs):
    sizes = {"b": [40] * 50, "a": [30 + i % 50 for i in range(60)], "c": [5] * 8,
             "d": [100] * 40, None: [7] * 90, "e": [0, 0]}
    rows = table(docs, sizes)
    got = mixing.mixture(rows).collect()
    want = shares({s: sum(v) for s, v in sizes.items()})
    by = {}
    source = {r.doc_id: r.source for r in rows.collect()}
    for r in got:
        name = source[r.doc_id]
        assert r.target == pytest.approx(want[name]) and r.source_size == sum(sizes[name])
        assert r.size == 0 or r.taken % r.size == 0
        assert r.taken <= 3 * r.size
        by[name] = by.get(name, 0) + r.taken
    for name, target in want.items():
        assert abs(by[name] - target) <= max(sizes[name]), name


def test_rows_are_repeated_and_reruns_agree(docs):
    sizes = {"a": [10] * 5, "b": [10] * 100, "c": [10] * 100}
    rows = table(docs, sizes)
    taken = {r.doc_id: r.taken // 10 for r in mixing.mixture(rows).collect()}
    for spread in (rows, rows.repartition(5)):
        left = mixing.mixed(spread)
        assert left.columns == rows.columns
        counts = {}
        for r in left.collect():
            counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
        assert counts == {i: n for i, n in taken.items() if n}


def test_longer_documents_are_likelier(docs):
    sizes = {"a": [10] * 300, "b": [10] * 1000 + [500] * 1000}
    rows = table(docs, sizes)
    # target of b is well below its size
    got = mixing.mixture(rows, weights=(1, 1)).collect()
    short = [r.taken > 0 for r in got if r.size == 10 and r.source_size > 5000]
    long = [r.taken > 0 for r in got if r.size == 500]
    assert sum(long) / len(long) > sum(short) / len(short)


def test_awkward_rows(docs):
    rows = [(None, "a b", "en", None), (None, "c d e", "en", None), (1, None, "en", "s"),
            (1, None, "en", "s"), (2, "x y", "en", "s"), (2, "x y", "en", "s")]
    got = mixing.mixture(docs(rows)).collect()
    assert len(got) == 6
    twins = [r.taken for r in got if r.doc_id == 2]
    assert twins[0] == twins[1]
    assert mixing.mixture(docs([])).count() == 0 and mixing.mixed(docs([])).count() == 0
    assert all(r.target == 0 and r.taken == 0
               for r in mixing.mixture(docs([(1, "", "en", "s")])).collect())


def test_no_python(docs):
    plan = mixing.mixed(table(docs, {"a": [3]}))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
