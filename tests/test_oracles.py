"""Every query of the trajectory library against its SQL on the smallest tables; those without SQL must give rows."""

import pytest

from stepwright.plans import registry

from compare import SF, connection, same_rows

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    same_rows(QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_is_repeatable(spark, name):
    a, b = (QUERIES[name](spark, SF).toPandas() for _ in range(2))
    assert len(a) > 0
    same_rows(a, b)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
