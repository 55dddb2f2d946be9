import pytest
from conftest import SF, rows

from inkloom.plans import catalog

CASES = sorted(catalog.queries())


@pytest.mark.parametrize("name", CASES)
def test_query_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    assert rows(got) == rows(duck.sql(sql).df())


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
