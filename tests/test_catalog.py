"""Every query of the library gives its SQL's rows on the smallest tables."""

import pytest

from foliant import catalog
from tests.oracle import difference, duck

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_rows_are_those_of_the_sql(spark, con, name):
    assert difference(spark, con, name, catalog.QUERIES[name], catalog.SQL[name], DATA) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_others_have_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
