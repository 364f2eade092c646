import random

from colloquy.llm import quality


def brute(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered.update(range(i, i + 5))
    return len(words), len(covered)


def test_repeated_words(docs):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60)))
             for _ in range(60)] + [None, "", "a", "a b c d e", "a a a a a", "a a a a a a"]
    table = docs(list(enumerate(texts)))
    got = {r.doc_id: (r.n_words, r.n_repeat_words) for r in quality.quality(table).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_bad_host_goes_and_good_host_stays(docs):
    good = " ".join(f"word{i}" for i in range(40))
    bad = " ".join(f"# ${i} %" for i in range(30))
    rows = [(i, good + f" {i}", "en", "good") for i in range(60)]
    rows += [(100 + i, bad + f" {i}", "en", "bad") for i in range(60)]
    rows += [(200, bad, "en", "small"), (201, good, "en", None)]
    got = {r.doc_id: r.kept for r in quality.quality(docs(rows)).collect()}
    assert all(got[i] for i in range(60)) and not any(got[100 + i] for i in range(60))
    assert got[201]
    left = quality.keep_good(docs(rows))
    assert left.columns == docs(rows).columns
    assert {r.doc_id for r in left.collect()} == {i for i, k in got.items() if k}


def test_drawn_rates_lean_to_the_common_rate(spark):
    rows = [("a", i < 50) for i in range(100)] + [("b", i < 10) for i in range(100)]
    rows += [("c", True)]
    table = spark.createDataFrame(rows, "host string, few boolean")
    rates = {r.host: r.few for r in quality.host_rates(table).collect()}
    assert 0.1 < rates["b"] < rates["a"] < 0.5 and rates["c"] < 0.9


def test_same_rates_give_one_rate(spark):
    table = spark.createDataFrame([(h, i < 3) for h in "abc" for i in range(10)],
                                  "host string, few boolean")
    rates = [r.few for r in quality.host_rates(table).collect()]
    assert all(abs(r - 0.3) < 1e-4 for r in rates)


def test_empty_table(docs):
    assert quality.quality(docs([])).count() == 0
    assert quality.keep_good(docs([])).count() == 0


def test_no_python(docs):
    plan = quality.keep_good(docs([(1, "a", "en", "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
