"""The plans that matter at scale stay as they are meant to be."""

import re

import pytest

from docquarry.queries import QUERIES


def plan(spark, data, name):
    return QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "has"),
    [
        ("latest_version", "WindowGroupLimit"), ("as_of_epoch", "WindowGroupLimit"), ("log_compaction", "WindowGroupLimit"), ("prefix_scan", "StringStartsWith(url,https://)"), ("point_get", "EqualTo(o_orderkey,42)"), ("as_of_epoch", "LessThanOrEqual(event_id,400)"),
        ("vector_topk_cosine", "TakeOrderedAndProject"), ("scan_limit_offset", "TakeOrderedAndProject"), ("cursor_page", "TakeOrderedAndProject"), ("text_search_single", "ReadSchema: struct<doc_id:bigint,text:string>"), ("filter_eq", "ReadSchema: struct<event_id:bigint,props:string>"), ("agg_grouped", "partial_sum"),
    ],
)
def test_plan_has(spark, data, name, has):
    assert has in plan(spark, data, name)


@pytest.mark.parametrize(("name", "n"), [("join_asof", 1), ("version_history", 1), ("version_gc", 1), ("latest_version", 1), ("text_search_all_terms", 0), ("filter_and", 0), ("partition_routing", 0), ("billing_cost", 1), ("rle_runs", 1)])
def test_shuffles(spark, data, name, n):
    assert len(re.findall(r"Exchange (?!SinglePartition)hashpartitioning|Exchange rangepartitioning", plan(spark, data, name))) == n


@pytest.mark.parametrize("name", ["filter_and", "text_search_all_terms", "vector_topk_l2", "vector_int8_topk_dot", "latest_version", "cdc_deliveries", "partition_routing", "join_asof", "branch_overlay", "regex_search"])
def test_no_python(spark, data, name):
    assert not re.search("Python|Arrow|Pandas", plan(spark, data, name))
