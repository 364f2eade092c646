import hashlib

import pytest
from pyspark.sql import functions as F

from colloquy.llm import exact_dedup
from colloquy.session import durable


def rows_of(n):
    return [(i, f"text {i % 7}" if i % 3 else "hot") for i in range(n)]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_against_brute_force(docs, keep, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", 8)
    rows = rows_of(200) + [(300, None), (301, ""), (302, "TEXT 1")]
    got = exact_dedup.duplicates(docs(rows).repartition(7), keep).collect()
    best = max if keep == "largest" else min
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        same = groups[text]
        assert (r.keep_id, r.group_size) == (best(same), len(same))
        assert r.kept == (r.doc_id == best(same))
        assert r.digest[:64] == hashlib.sha256(text.encode()).hexdigest()


def test_many_rounds_give_one_entry_per_digest(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FAN", 2)
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", 16)
    rows = spark.range(500).select(
        exact_dedup.digest_of((F.col("id") % 90).cast("string")).alias("digest"), "id")
    got = exact_dedup.digest_classes(rows.repartition(9), 500, "smallest").collect()
    assert len(got) == 90
    assert {r.keep_id for r in got} == set(range(90))
    assert sum(r.copies for r in got) == 500


@pytest.mark.parametrize("partitions", [1, 9, 40])
def test_groups_are_of_like_size_in_all_rounds(spark, monkeypatch, partitions):
    """A group of any round has about what two runs hold."""
    monkeypatch.setattr(exact_dedup, "FAN", 4)
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", 16)
    slices = 4 ** 4
    rows = spark.range(0, 2000, 1, partitions).select(
        F.spark_partition_id().cast("bigint").alias("part"),
        exact_dedup.digest_of(F.col("id").cast("string")).alias("digest"), "id")
    runs = exact_dedup.digest_runs(rows, slices, False).transform(durable)
    entries = runs.groupBy("run").count().agg(F.max("count")).first()[0]
    assert entries <= 2 * 3 * 16  # two runs may have one number
    for round_no in range(1, 5):
        runs = exact_dedup.merge_round(runs, round_no, slices, False).transform(durable)
        block = (F.col("slice") / (slices // 4 ** round_no)).cast("bigint")
        sizes = [r["count"] for r in runs.groupBy("run", block.alias("b")).count().collect()]
        assert sum(sizes) == 2000 and max(sizes) <= 4 * 16
        assert len(sizes) >= slices / 4


@pytest.mark.parametrize("keep,best", [("smallest", 0), ("largest", 99_999)])
def test_hot_digest_leaves_a_run_once(spark, keep, best):
    """Ten Arrow batches of one text are one entry."""
    digest = exact_dedup.digest_of(F.lit("hot"))
    rows = spark.range(0, 100_000, 1, 1).select(
        F.lit(0).cast("bigint").alias("part"), digest.alias("digest"), "id")
    got = exact_dedup.digest_runs(rows, 256, keep == "largest").collect()
    assert [(r.id, r.copies) for r in got] == [(best, 100_000)]


def test_hot_digest_among_others_leaves_a_piece_once(spark):
    text = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
    rows = spark.range(0, 120_000, 1, 1).select(
        F.lit(0).cast("bigint").alias("part"),
        exact_dedup.digest_of(text).alias("digest"), "id")
    got = exact_dedup.digest_runs(rows, 256, False).collect()
    hot = [r for r in got if r.copies > 1]
    assert sum(r.copies for r in got) == 120_000
    assert len(got) - len(hot) <= 80_000 and len(hot) <= 80_000 // exact_dedup.RUN_ROWS + 1


def test_null_ids_and_repeated_rows(docs):
    rows = [(None, "x"), (5, "x"), (None, "y"), (None, "y"), (7, "z"), (7, "z"), (8, "z")]
    got = exact_dedup.duplicates(docs(rows), "smallest").collect()
    assert sum(r.kept for r in got) == 3
    assert {r.keep_id for r in got if r.digest == got[0].digest} <= {5, 7, None}
    left = exact_dedup.drop_copies(docs(rows))
    assert left.columns == docs(rows).columns
    assert sorted((r.doc_id or -1, r.text) for r in left.collect()) == [
        (-1, "y"), (5, "x"), (7, "z")]


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_one_of_many_rows_with_one_id_and_text_is_the_same_in_reruns(spark, partitions):
    """A third of the table has one id and text, under a thousand sources."""
    hot = F.col("n") % 3 == 0
    table = (spark.range(0, 300_000, 1, partitions).withColumnRenamed("id", "n")
             .select(F.when(hot, 5).otherwise(F.col("n") + 10).alias("doc_id"),
                     F.when(hot, "hot").otherwise(F.col("n").cast("string")).alias("text"),
                     (F.col("n") % 1000).cast("string").alias("source")))
    left = exact_dedup.drop_copies(table.repartition(partitions))
    assert left.columns == table.columns and left.count() == 200_001
    picked = min(range(1000), key=lambda s: hashlib.sha256(
        f'{{"source":"{s}"}}'.encode()).hexdigest())
    assert [tuple(r) for r in left.filter("text = 'hot'").collect()] == [
        (5, "hot", str(picked))]


def test_empty_table(docs):
    assert exact_dedup.duplicates(docs([])).count() == 0
    assert exact_dedup.drop_copies(docs([])).count() == 0


def test_wrong_keep(docs):
    with pytest.raises(ValueError, match="smallest or largest"):
        exact_dedup.duplicates(docs([(1, "a")]), "first")
