"""Every query with SQL against DuckDB, exactly, on the smallest and the middle data."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from tests.support import normalised, open_duckdb

FOLDERS = ["/root/testdata/sf0.001"]
if os.environ.get("COMEBACK_FULL_TESTS"):
    FOLDERS.append("/root/testdata/sf0.01")
SQL = contract.oracle_sql()


@pytest.fixture(scope="module", params=FOLDERS)
def folder(request):
    return request.param


@pytest.fixture(scope="module")
def database(folder):
    connection = open_duckdb(folder)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, database, folder, name):
    frame = contract.queries()[name](spark, folder)
    relation = database.sql(SQL[name])
    assert sorted(frame.columns) == sorted(relation.columns)
    got = normalised(frame.columns, [tuple(row) for row in frame.collect()])
    assert got == normalised(relation.columns, relation.fetchall())


def test_contract(spark):
    assert contract.entry(spark).columns == [
        "agent_speed",
        "total_users",
        "successful",
        "success_rate",
        "ci_lo",
        "ci_hi",
    ]
    assert set(SQL) <= set(contract.queries())
