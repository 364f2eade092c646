"""Queries against their SQL, and what holds for all of them."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from colloquy.llm.oracle import ORACLES
from colloquy.llm.queries import QUERIES
from scripts.check import TABLES, compare


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, con, sf_dir, name):
    line, ok = compare(spark, con, name, sf_dir, ORACLES[name])
    assert ok, line


def test_registered():
    queries = entry_module.queries()
    assert set(QUERIES) | {"pipeline"} <= set(queries)
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}


def test_sql_on_awkward_rows(spark, con, docs, tmp_path):
    """The same on nulls, blanks, repeats and few words."""
    rows = [(1, "a b c", "en", "s1"), (2, None, None, None), (3, "", "en", ""),
            (4, "x " * 30, "en", "s1"), (5, "one two three four five six seven eight nine ten",
                                         "en", "s2"),
            (6, "line one\nline one\n\nline two # | <", "en", "s2"), (7, "a b c", "en", None),
            (8, "a b c", "en", "s1"), (9, "\t \x0b\r\n", "en", "s3"),
            (10, "é𝄞 ü " * 20, "fr", "s3"),
            *[(n, f"w{n} " + " ".join(f"v{n * k % 17}" for k in range(60)), "en", "s4")
              for n in range(11, 40)]]
    folder = tmp_path / "t"
    docs(rows).write.parquet(str(folder / "documents.parquet"))
    connection = duckdb.connect()
    connection.execute(
        f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    for name in ORACLES:
        if name == "op12_prefix_trie":
            continue  # reads conversations; test_prefix_trie.py has awkward ones
        line, ok = compare(spark, connection, name, str(folder), ORACLES[name])
        assert ok, (name, line)
