"""Every registered query against its SQL oracle."""

import os

import pytest

import __spark_entry__ as entry_points
from trailmine.plans.queries import queries

duckdb = pytest.importorskip("duckdb")
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
EVENTS = f"{SF_DIR}/events.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(EVENTS), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW events AS SELECT * FROM '{EVENTS}'")
    yield connection
    connection.close()


def sorted_rows(rows, columns, names):
    at = [columns.index(name) for name in names]
    return sorted((tuple(row[i] for i in at) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_oracle(spark, con, name):
    result = entry_points.queries()[name](spark, SF_DIR)
    expected = con.sql(entry_points.oracle_sql()[name])
    names = sorted(expected.columns)
    assert sorted(result.columns) == names
    assert sorted_rows(map(tuple, result.collect()), result.columns, names) == sorted_rows(
        expected.fetchall(), expected.columns, names
    )


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.columns == ["len", "rank", "total", "topics", "part", "parts", "queries"]
    assert result.count() > 0


def test_every_query_has_an_oracle():
    assert queries().keys() <= entry_points.oracle_sql().keys() <= entry_points.queries().keys()
