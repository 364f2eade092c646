import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from colloquy.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "\n", "a  b", "  a", "a \n b ", "a\n \nb", "it's 's we'll", "\t\t x \x1c y",
         "x<|endoftext|> y<|endoftext|>", "<|endoftext|>", "é ½ ² 　 a", "a b\x85 d",
         "😀😀 👩‍👩‍👧 z", "a" * 3000, "ab" * 500 + " " * 40, "1234 5²½Ⅷ 一二", "a\r\n b",
         "\x00 a\x00", "é x", " leading", "trailing  ", "Ab, (c) -- d!"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_same_ids_as_the_library(library, spark, sf_dir):
    found = bpe.codec(PATH)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for text in TEXTS + texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert found.encode(text) == ids, text[:80]
        assert found.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)
    known = bpe.Codec(PATH)
    text = " ".join(f"word{i}" for i in range(300))
    assert known.decode(known.encode(text)) == text
    assert len(known.young) <= 10 and len(known.old) <= 10 and len(known.piece_ids) <= 10


def test_small_tables_give_the_same(spark, library):
    """A caller with little memory names the size of the tables."""
    rows = [(n, " ".join(f"word{n * i} x" for i in range(40)), n) for n in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, other int")
    got = {r.doc_id: r for r in bpe.encode(docs, PATH, "doc_id", decoded=True, held=7).collect()}
    for n, text, _ in rows:
        assert list(got[n].ids) == library.encode(text, add_special_tokens=False).ids
        assert got[n].decoded == text
    known = bpe.Codec(PATH, 7)
    known.encode_all([text for _, text, _ in rows])
    assert max(len(known.young), len(known.old), len(known.piece_ids)) <= 7


@pytest.mark.parametrize("between", ["\n", "\t", "", "\n\n", "."])
def test_time_is_linear_without_blanks(library, between):
    """Also where nothing but line feeds, or nothing at all, divides the words."""
    def text(n):
        letters = "一丁七万三上下不与" if not between else "abcdefghi"
        return between.join("".join(letters[(i * k) % 9] for k in (1, 2, 5)) for i in range(n))

    def spent(n):
        known, whole = bpe.Codec(PATH), text(n)
        start = time.process_time()
        ids = known.encode(whole)
        return time.process_time() - start, ids, whole

    few, _, _ = spent(20_000)
    many, ids, whole = spent(200_000)
    assert many < 30 * few + 1
    assert ids == library.encode(whole, add_special_tokens=False).ids


def test_parts_of_characters_are_replaced(library):
    ids = library.encode("😀", add_special_tokens=False).ids[:1]
    assert bpe.codec(PATH).decode(ids) == library.decode(ids) == "�"


def test_tables(docs, monkeypatch):
    monkeypatch.setattr(bpe, "OUT_ROWS", 3)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, "a  b")]
    table = docs(rows)
    coded = bpe.encode(table, PATH, "doc_id", "text", decoded=True)
    got = coded.collect()
    assert len(got) == len(rows)
    assert all(r.decoded == (r.text or "") for r in got)
    back = bpe.decode(coded, PATH, "doc_id", "text")
    assert all(r.decoded == (r.text or "") for r in back.collect())
    assert bpe.encode(docs([]), PATH, "doc_id").count() == 0
    nothing = coded.selectExpr("doc_id", "cast(null as array<int>) as ids")
    assert {r.decoded for r in bpe.decode(nothing, PATH, "doc_id").collect()} == {""}
