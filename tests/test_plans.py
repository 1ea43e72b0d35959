"""Facts about physical plans that decide whether a query survives large tables."""

import os
import re

import pytest

import __spark_entry__ as contract
from conftest import ROOT, SMALL
from strata.plans import suite


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when every side is beyond the broadcast limit."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", list(suite.QUERIES))
def test_no_product_joins_no_python(no_broadcast, name):
    plan = plan_of(suite.QUERIES[name](no_broadcast, SMALL))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BroadcastHashJoin|Python|ArrowEval", plan)
    for line in plan.splitlines():
        assert not re.search(r"Window \[.*\], \[\]|Window \[.*windowspecdefinition\(specified", line), line


@pytest.mark.parametrize("name", ["merge_columns", "merge_columns_unread"])
def test_columns_meet_sorted_however_small_their_files_are(spark, name):
    plan = plan_of(suite.QUERIES[name](spark, SMALL))
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(contract.queries()["dws_user_active"](spark, SMALL))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan
    plan = plan_of(contract.queries()["report_data_params"](spark, SMALL))
    assert "GreaterThanOrEqual(o_orderdate" in plan


def test_retention_of_snapshots_limits_rows_before_the_shuffle(spark):
    plan = plan_of(contract.queries()["snapshots_to_expire"](spark, SMALL))
    assert "row_number(), 10, Partial" in plan


def test_daily_sales_reuse_the_placement_by_order(no_broadcast):
    plan = plan_of(contract.queries()["dws_daily_sales"](no_broadcast, SMALL))
    assert "hashpartitioning(dt" in plan and "hashpartitioning(dt#" in plan and ", order_key#" not in "".join(
        re.findall(r"hashpartitioning\([^)]*\)", plan))


def test_library_uses_no_forced_broadcast_no_local_checkpoint_no_group_lists():
    for base, folders, names in os.walk(os.path.join(ROOT, "strata")):
        if "llm" in folders:
            folders.remove("llm")  # has tests of its own
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(base, name)) as file:
                    text = file.read()
                assert not re.search(r"F\.broadcast|localCheckpoint|collect_list|collect_set|crossJoin|\.rdd\b|toPandas", text), name
