"""Registered corpus queries: against their SQL where there is one, and repeatable."""

import pytest

from stepwright.llm import registry

from compare import SF, connection, same_rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same_rows(registry.queries()[name](spark, SF).toPandas(), connection().execute(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_has_a_row_for_each_document(spark, name):
    rows = registry.queries()[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0 < rows.count() <= n if name.startswith("op7") else rows.count() == n
