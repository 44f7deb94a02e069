"""Plan properties the design relies on (read from the physical plans)."""

import re

import pytest

import __spark_entry__ as E

SMALL = "/root/testdata/sf0.001"
LIBRARY = sorted(n for n in E.queries() if n != "pipeline" and not re.match(r"op\d+_", n))
FIT_QUERIES = {"logistic_auc", "chi_select"}  # run model fits while building


def _plan(spark, name):
    df = E.queries()[name](spark, SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(LIBRARY) - FIT_QUERIES))
def test_no_cross_or_nested_loop_join(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_used_columns(spark):
    plan = _plan(spark, "token_count")
    assert "ReadSchema: struct<event_type:string>" in plan


def test_arg_max_broadcasts_one_row(spark):
    plan = _plan(spark, "busiest_pair")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_month_mapping_is_hash_join_on_month_start(spark):
    plan = _plan(spark, "visit_month")
    assert re.search(r"BroadcastHashJoin \[_month#\d+\], \[start_dt#\d+\]", plan)


def test_top_k_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in _plan(spark, "top_users")


def test_chi_square_has_no_window(spark):
    plan = _plan(spark, "chi_square_features")
    assert "Window" not in plan


def test_quantile_window_is_partitioned(spark):
    """Ranks are searched inside one range partition; nothing is sketched or gathered."""
    plan = _plan(spark, "quartiles_exact")
    assert re.search(r"Exchange hashpartitioning\(g#\d+, part#\d+, ", plan)
    assert "SinglePartition" not in plan.split("HashAggregate", 2)[2]
    assert "percentile" not in plan


@pytest.mark.parametrize("name", sorted(set(LIBRARY) - FIT_QUERIES - {"missing_counts"}))
def test_large_text_column_is_pruned(spark, name):
    """documents.text (up to 20,000 words a row) is read only where needed."""
    plan = _plan(spark, name)
    for m in re.finditer(r"ReadSchema: (struct<[^>]*>)", plan):
        assert "text:string" not in m.group(1) or "doc_id" not in m.group(1), name
