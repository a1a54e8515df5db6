import pytest

from skein.plans import cases, catalog  # noqa: F401
from tests import oracle
from tests.conftest import DATA


@pytest.fixture(scope="module")
def conn():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, conn, name):
    oracle.same(spark, DATA, catalog.QUERIES[name], catalog.SQL[name], conn)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
