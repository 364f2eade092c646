from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.llm import language
from colloquy.llm.queries import op3_language


def brute(text):
    found = Counter()
    chars = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
                    for c in text or "")
    found.update(c for c in chars if c != " ")
    edged = f" {chars} "
    for i in range(len(edged) - 1):
        if edged[i:i + 2] != "  ":
            found[edged[i:i + 2]] += 1
    for i in range(len(edged) - 2):
        if edged[i + 1] != " ":
            found[edged[i:i + 3]] += 1
    return found


@pytest.mark.parametrize("piece", [1 << 20, 5])
def test_ngrams(monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    for text in ["", "a", "a b", "1 2", "Hello, World", "é--É İx \U00020000y", "aaa aaa" * 9]:
        codes, counts = language.ngrams(text)
        assert sorted(counts.tolist()) == sorted(brute(text).values()), text
        assert len(set(codes.tolist())) == len(codes)


def test_distance_of_a_profile_to_itself_is_zero():
    own = language.ranked(*language.ngrams("the cat and the dog and the bird"))
    known = language.Profiles({"en": own.tolist(), "xx": [1, 2, 3]})
    assert known.distances(own)[0] == 0 < known.distances(own)[1]
    assert known.best("the cat and the dog and the bird") == ("en", 1.0)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = op3_language(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id")
    tested = got.filter("held_out and lang is not null")
    assert tested.filter("lang = lang_pred").count() >= 0.95 * tested.count() > 0
    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    assert got.filter(F.col("held_out") != fold).count() == 0


def test_awkward_rows(docs):
    rows = [(i, "the cat and the dog", "en") for i in range(8)]
    rows += [(10 + i, "der hund und die katze", "de") for i in range(8)]
    rows += [(30, None, "en"), (31, "", None), (32, "12 34 !", "de"), (None, "und der hund", None)]
    got = {r.doc_id: r for r in language.identify(docs(rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (30, 31, 32))
    assert got[None].lang_pred == "de" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(docs([])).count() == 0
    lone = language.identify(docs([(1, "abc", None)])).collect()
    assert lone[0].lang_pred == "und"
