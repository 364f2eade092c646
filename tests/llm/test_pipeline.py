"""The pipeline against a plain Python version of its stages."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from colloquy.llm import mixing
from tests.llm.test_quality import brute as word_counts
from tests.llm.test_simhash import brute_classes, brute_print


def test_run_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect())
    good = []
    for doc_id, text, source in rows:
        n_words, n_repeat = word_counts(text)
        if n_words >= 10 and 100 * n_repeat <= 20 * n_words:
            good.append((doc_id, text, source))
    different = list({t: (i, t, s) for i, t, s in reversed(good)}.values())[::-1]
    different.sort()
    label = brute_classes([brute_print(t) for _, t, _ in different])
    left = [row for n, row in enumerate(different) if label[n] == n]
    table = spark.createDataFrame(left, "doc_id bigint, text string, source string")
    copies = {r.doc_id: r.taken // r.size for r in mixing.mixture(table).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i, hashlib.sha256(str(
        tokenizer.encode(t, add_special_tokens=False).ids).encode()).hexdigest())
        for i, t, _ in left for _ in range(copies[i]))
    out = corpus_pipeline.run(spark, sf_dir).collect()
    got = sorted((r.doc_id, hashlib.sha256(str(list(r.ids)).encode()).hexdigest())
                 for r in out)
    assert got == want and len(got) > 100
    assert all(r.intact and r.n_tokens == len(r.ids) for r in out)


def test_stages_keep_the_columns(spark, docs, tmp_path):
    text = " ".join(f"w{i}" for i in range(30))
    table = docs([(1, text, "en", "a"), (2, text, "en", "a"), (3, None, None, None),
                  (None, text + " x", "en", None), (1, text, "en", "a")])
    columns = table.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, str(tmp_path))
        assert table.columns == columns, name
        table.write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
    assert len(corpus_pipeline.STAGES) == 5
    out = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path))
    assert {r.doc_id for r in out.collect()} <= {1, None}


def test_host_that_fails_different_rules_goes(spark, docs, tmp_path):
    """Beside clean hosts one with 45 % symbols, 45 % repeated lines, 10 % good."""
    def text(i):
        return " ".join(f"word{i}x{k}" for k in range(40))

    def junk(i):
        if i % 20 < 9:
            return text(i) + " # $ % & | < > * # $"
        if i % 20 < 18:
            return text(i) + "\nsame\nsame\nsame\nsame"
        return text(i)

    rows = [(1000 * h + i, text(1000 * h + i), "en", f"clean{h}")
            for h in range(3) for i in range(100)]
    rows += [(9000 + i, junk(9000 + i), "en", "bad") for i in range(100)]
    rows += [(9900, text(9900), "en", None)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = corpus_pipeline.quality_stage(spark, table, str(tmp_path))
    assert {r.doc_id for r in left.collect()} == {r[0] for r in rows if r[3] != "bad"}
    sources = {r.source for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sources and sources <= {"clean0", "clean1", "clean2", None}


def test_empty_table(spark, docs, tmp_path):
    docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
