"""Every registered query against its checking statement, over whole small tables."""

import pytest

import __spark_entry__ as entry
from compare import compare_one, connect
from karavel.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()  # tests/llm has those of the corpus


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_statement(spark, con, name):
    state, detail = compare_one(spark, con, FOLDER, name, QUERIES[name], ORACLES.get(name))
    assert state == "OK", detail


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLES)


def test_entry_gives_one_verdict(spark):
    row = entry.entry(spark).first()
    assert row["exit_code"] == 2 and row["passed"] >= 1 and row["failed"] >= 1
