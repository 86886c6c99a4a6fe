"""Every query of the spatial engine against its SQL, and a plain run of those without SQL."""

import pytest

from pointweave import catalog
from tests.compare import SF, spark_rows, sql_rows

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[:2] == ["image_id", "component"]
