"""Every registered query of the engine against its SQL twin."""

import pytest
from conftest import SF, rows

from terrapix.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = rows(QUERIES[name](spark, SF))
    if name in ORACLE_SQL:
        assert got == rows(duck.execute(ORACLE_SQL[name]).df())
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
