"""Every catalogue query against its independent SQL on the smallest data."""

import pytest
from compare import connect, differences

from tablekeep.plans import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    if name not in CHECKS:
        assert QUERIES[name](spark, FOLDER).count() >= 0
        return
    problem, _ = differences(spark, FOLDER, QUERIES[name], CHECKS[name], con)
    assert problem is None, problem


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "gid"
