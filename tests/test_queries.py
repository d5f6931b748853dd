"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, differences

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLE:
        assert differences(got, con.execute(ORACLE[name]).df()) is None
    else:
        assert len(got) > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(ORACLE) <= set(QUERIES)
