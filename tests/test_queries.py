"""Every query runs; those with a SQL twin give exactly its rows."""

import pytest

import __spark_entry__ as entry_point
from finsieve.plans import ORACLES, QUERIES
from finsieve.plans.checks import compare, connect


@pytest.fixture(scope="module")
def duck(sf_dir):
    pytest.importorskip("duckdb")
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    assert compare(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_points(spark):
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert entry_point.entry(spark).columns[:3] == ["row_idx", "split", "label"]
