"""Plans keep the properties that matter on large tables."""

import pytest

import __spark_entry__ as entry


def plan_of(spark, sf_dir, name):
    return entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_time_range_reaches_the_scan(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "spend_totals")
    assert "GreaterThanOrEqual(o_orderdate,2001-01-01" in plan
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp>" in plan


def test_last_rows_are_limited_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan_of(spark, sf_dir, "last_prices")


@pytest.mark.parametrize("name", ["extract_total_documents", "extract_items_documents", "low_text_quality"])
def test_reading_text_only_deals_out_rows(spark, sf_dir, name):
    plan = plan_of(spark, sf_dir, name)
    assert plan.count("Exchange") == plan.count("Exchange RoundRobinPartitioning")


@pytest.mark.parametrize("name", ["top_price_increases", "store_prices", "dedupe_stores", "dedupe_report", "semantic_duplicates", "scan_receipt_files"])
def test_no_cross_joins(spark, sf_dir, name):
    plan = plan_of(spark, sf_dir, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["recent_receipts", "dedupe_recent_receipts"])
def test_top_rows_need_no_full_sort(spark, sf_dir, name):
    assert "TakeOrderedAndProject" in plan_of(spark, sf_dir, name)
