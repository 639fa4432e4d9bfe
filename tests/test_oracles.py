"""Every query of the core against its SQL."""

import pytest
from oracle import differences

from engramlake.plans import core, memory

ORACLES = core.ORACLES | memory.ORACLES


class Entry:
    queries = staticmethod(lambda: core.QUERIES | memory.QUERIES)
    oracle_sql = staticmethod(lambda: ORACLES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_as_sql(spark, small, name):
    assert differences(spark, small, name, Entry) == ""


def test_every_query_has_rows_or_sql(spark, small):
    for name, f in (core.QUERIES | memory.QUERIES).items():
        if name not in ORACLES:
            assert f(spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
