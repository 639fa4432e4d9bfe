import pytest
from oracle import differences

from engramlake.llm import queries


class Entry:
    queries = staticmethod(lambda: queries.QUERIES)
    oracle_sql = staticmethod(lambda: queries.ORACLES)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_same_as_sql(spark, small, name):
    assert differences(spark, small, name, Entry) == ""


def test_others_run(spark, small):
    for name, f in queries.QUERIES.items():
        if name not in queries.ORACLES:
            assert f(spark, small).count() >= 0
