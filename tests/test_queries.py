"""Every query of the core against its SQL, on the same files."""

from importlib import import_module

import pytest

import __spark_entry__ as entry
from tests.oracle import difference, views

MODULES = [import_module(f"loamworks.plans.{name}") for name in entry.FAMILIES]
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
#: Results that are empty on purpose.
EMPTY = set()


@pytest.fixture(scope="module")
def con(data):
    return views(f"{data}/sf0.01")


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, data, name):
    assert difference(QUERIES[name](spark, f"{data}/sf0.01"), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_twice_alike(spark, data, name):
    """Queries without SQL give the same rows each time."""
    first, second = (sorted(map(repr, QUERIES[name](spark, f"{data}/sf0.001").collect())) for _ in range(2))
    assert first == second


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
