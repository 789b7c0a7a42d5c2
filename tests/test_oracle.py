import pytest

from conftest import SF_DIR
from oracle import compare, connect
from rolltally.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    connection = connect(SF_DIR)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, QUERIES[name], ORACLES[name]) == []


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() == 5
    assert set(oracle_sql()) <= set(queries())
