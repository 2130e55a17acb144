"""Every registered query against its SQL on the smallest tables, and every other one for rows and stability."""

import pytest

from tests.oracle import connect, rows_of, rows_of_sql
from trailweave.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, db, name):
    assert rows_of(QUERIES[name](spark, DIR)) == rows_of_sql(db, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_twice_alike(spark, name):
    first = rows_of(QUERIES[name](spark, DIR))
    assert first == rows_of(QUERIES[name](spark, DIR))
    assert first[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[:3] == ["d", "stage_index", "stage_name"]
    assert set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries())
