"""Every library query gives the rows of its SQL."""

import pytest

import __spark_entry__
from tests.conftest import SF
from tests.oracle import differences, tables
from tonearm import queries as library


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(library.ORACLE_SQL))
def test_rows_match_sql(spark, con, name):
    assert not differences(library.QUERIES[name](spark, SF), con, library.ORACLE_SQL[name])


def test_every_query_has_rows_or_sql(spark):
    for name in set(library.QUERIES) - set(library.ORACLE_SQL):
        assert library.QUERIES[name](spark, SF).columns, name


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
