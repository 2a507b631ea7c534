import pytest
from same_rows import assert_same

from docquarry.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_as_sql(spark, data, name):
    assert_same(QUERIES[name](spark, data), ORACLES[name], data)


def test_all_ten_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_entry_has_them():
    import __spark_entry__ as e

    assert set(QUERIES) | {"pipeline"} <= set(e.queries())
