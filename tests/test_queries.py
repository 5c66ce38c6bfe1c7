"""Every registered query of the engine's own operators against its SQL, on the smallest tables."""

import pytest

from compare import connection, differences
from sievewright.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert differences(df, duck, ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_entry_has_all(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
