"""Plan shapes that matter at scale (checked on the physical plan)."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_top_n_per_group_is_limited_before_the_shuffle(spark):
    p = plan(spark, "capped_sample")
    assert "WindowGroupLimit" in p and "Partial" in p


@pytest.mark.parametrize("name", ["compilable_rate_by_project", "build_status", "orders_histogram"])
def test_aggregates_are_partial_before_the_shuffle(spark, name):
    p = plan(spark, name)
    assert "partial_" in p


def test_top_one_per_group_uses_map_side_reduction(spark):
    p = plan(spark, "weighted_sample")
    assert "partial_min_by" in p


def test_scans_read_only_needed_columns(spark):
    p = plan(spark, "compilable_rate_by_project")
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in p
    p = plan(spark, "weighted_sample")
    assert "PushedFilters: [IsNotNull(n_chars)" in p


def test_no_planning_time_broadcast_of_data(spark):
    # with the session defaults only AQE broadcasts, on measured sizes
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    for name in ["refill_files", "fim_prompts", "lookup_chain", "type_context"]:
        assert "BroadcastExchange" not in plan(spark, name), name


def test_span_work_is_one_python_stage_without_text_joins(spark):
    p = plan(spark, "function_spans")
    assert p.count("MapInArrow") == 1
    assert "SortMergeJoin" not in p and "BroadcastHashJoin" not in p
