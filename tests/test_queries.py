import pytest
from sqlcheck import FOLDER, rows_of, rows_of_sql

from clonelake.plans import core_queries, reference_queries

BOTH = {**core_queries.QUERIES, **reference_queries.QUERIES}
SQL = {**core_queries.SQL, **reference_queries.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert rows_of(BOTH[name](spark, FOLDER)) == rows_of_sql(SQL[name])


@pytest.mark.parametrize("name", sorted(set(BOTH) - set(SQL)))
def test_runs(spark, name):
    assert BOTH[name](spark, FOLDER).count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
