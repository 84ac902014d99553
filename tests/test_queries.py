"""Every registered query of the event study runs over the driver's tables; those with a SQL form give its rows."""

import os

import pytest

from almanac import plans
from tests.compare import connection, difference

SF = os.environ.get("ALMANAC_SF", "/root/testdata/sf0.001")
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = connection(SF)
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_those_of_the_sql_form(spark, con, name):
    assert difference(QUERIES[name](spark, SF), SQL[name], con) == ""


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_queries_without_a_sql_form_run(spark, name):
    out = QUERIES[name](spark, SF)
    assert out.columns and out.toArrow().num_rows > 0


def test_the_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert "ticker" in out.columns and out.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
