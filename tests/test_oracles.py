"""Every catalogued query against its SQL."""

import pytest

from tessera.plans import catalogue
from tests.oracle import connect, differences

catalogue.load_all()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    if name in catalogue.ORACLES:
        assert differences(df, catalogue.ORACLES[name], con) is None
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
