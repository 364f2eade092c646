"""Every registered query against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from colloquy.plans.oracle import ORACLES
from colloquy.plans.queries import QUERIES
from scripts.check import TABLES, compare


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    line, ok = compare(spark, con, name, sf_dir, ORACLES[name])
    assert ok, line


def test_flagship(spark):
    assert entry_module.entry(spark).count() == 114
