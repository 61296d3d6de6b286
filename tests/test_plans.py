"""Plan shape guards: no cross / nested-loop joins, no Python evaluation,
filters reach the Parquet scan."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tools.plan_audit import final_plan, risky_nodes

SAMPLE = ["flagship", "classification_scores", "roc_curve", "histogram_bins", "box_stats_ungrouped",
          "percent_counts", "category_report", "split_stratified", "shapley_linear", "class_weights"]


@pytest.mark.parametrize("name", SAMPLE)
def test_no_risky_nodes(spark, name):
    assert risky_nodes(final_plan(E.queries()[name](spark, SF_SMALL))) == {}


def test_filter_and_projection_reach_scan(spark):
    plan = final_plan(E.queries()["filter_isin"](spark, SF_SMALL))
    assert "PushedFilters: [In(l_returnflag, [A,N])" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_returnflag:string>" in plan


@pytest.mark.parametrize("name", ["split_stratified", "split_random", "split_three", "sample_proportional"])
def test_splits_do_not_shuffle_the_table(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    assert "Window" not in plan
