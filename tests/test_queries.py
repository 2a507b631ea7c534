import pytest
from same_rows import assert_same

import docquarry.store_queries  # noqa: F401  (registers its own)
from docquarry.queries import ORACLES, QUERIES, entry


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_same_as_sql(spark, data, name):
    assert_same(QUERIES[name](spark, data), ORACLES[name], data)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    assert entry(spark, data).columns == ["count", "sum", "avg", "min", "max"]


def test_filter_reaches_the_scan(spark, data):
    plan = entry(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(event_type,click)" in plan and "GreaterThan(value,50.0)" in plan
