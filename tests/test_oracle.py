"""Every registered query against its SQL: on the smallest tables, or, where these hold too
few subjects to yield a row, on the next size."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from voxtally.plans import catalog

RUNS, SQL = catalog.queries(), catalog.oracle_sql()
FOLDERS = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def connections(folder):
    return {f: connect(f) for f in FOLDERS}


def test_every_query_has_sql():
    assert set(SQL) == set(RUNS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, connections, name):
    for folder in FOLDERS:
        problem = difference(RUNS[name](spark, folder), connections[folder], SQL[name])
        if problem != "both empty":
            break
    assert problem is None, problem


def test_entry_runs(spark, folder):
    assert entry.entry(spark).limit(1).count() == 1
