import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import toxicity


def corpus(n):
    rng = random.Random(8)
    syllables = ["ba", "ko", "ri", "tu", "men", "sal", "vor", "ti"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(3)) for _ in range(60)]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["idiotic", "worthless", "disgusting"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model():
    rows, labels = corpus(600)
    return toxicity.train([toxicity.bag(t) for _, t in rows],
                          np.array([y for _, y in labels]))


def test_unseen_misspellings_are_near(model):
    clean = "bakori tumen salvor " * 20
    plain, odd, strange = model.score(
        [clean, clean + "worthles disgustingg idiotik " * 2, clean + "kotiri " * 6])
    assert plain < 0.3 and strange < 0.3 and odd > 0.7


def test_training_repeats():
    rows, labels = corpus(90)
    bags = [toxicity.bag(t) for _, t in rows]
    y = np.array([v for _, v in labels])
    assert (toxicity.train(bags, y).shares == toxicity.train(bags, y).shares).all()


def test_bag_is_the_mean_of_word_means():
    used, parts = toxicity.bag("one two two")
    assert parts.sum() == pytest.approx(3 / (3 + toxicity.NEUTRAL))
    rows, sizes = toxicity.subwords(["one", "two"])
    assert set(rows.tolist()) == set(used.tolist()) and sizes.sum() == len(rows)
    alone, _ = toxicity.subwords(["two"])
    assert (rows[sizes[0]:] == alone).all()
    assert len(toxicity.bag(None)[0]) == 0 and len(toxicity.bag(" ")[0]) == 0


def test_query_columns_and_held_out_rows(spark, docs):
    rows, labels = corpus(300)
    rows += [(1000, None), (1001, ""), (None, "idiotic worthless"), (3, "second text")]
    labels += [(None, 1), (2000, 1), (5, None), (0, 1)]
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs(rows), table)
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    assert got.filter(F.col("held_out") != fold).count() == 0
    out = got.collect()
    assert len(out) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    truth = dict(corpus(300)[1])
    tested = [r for r in out if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in tested)
    assert right >= 0.9 * len(tested) > 0


def test_sample_is_bounded_and_leaves_the_fold_out(spark, docs):
    rows, labels = corpus(300)
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    found = toxicity.sample(docs(rows), table, 30).collect()
    assert len(found) == 30 and sum(r.toxic for r in found) == 10
    held = {r.doc_id for r in docs(rows).filter(toxicity.held_out(F.col("doc_id"))).collect()}
    assert not held & {r.doc_id for r in found}


def test_one_class_only_and_empty_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.toxicity(docs([]), none).count() == 0
    got = toxicity.toxicity(docs([(1, "a"), (2, "b")]), none).collect()
    assert all(r.score < 0.01 and r.predicted == 0 for r in got)
