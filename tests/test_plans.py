"""Plan-shape checks: the scale properties the operators promise."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from sowline.operators.quantiles import exact_quantiles

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_quantiles_never_merges_a_group_in_one_aggregate(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 0.5).alias("v"))
    plan = plan_of(exact_quantiles(df, ["g"], "v", {"p50": 0.5}))
    assert "percentile" not in plan.lower()
    # value-level sorts happen per (group, bucket); group-level windows only
    # ever see the bucket histogram (sums of __c / __cnt)
    for m in re.findall(r"Window \[(sum\((__c|__cnt)L?#?\d*L?\)[^\]]*)\]", plan):
        spec = m[0]
        assert m[1] == "__cnt" or "__b" in spec


def test_gap_window_sorts_per_hour_block(spark):
    plan = plan_of(E.queries()["machine_downtime"](spark, SF))
    leads = [m for m in re.findall(r"Window \[lead\(start_us[^\]]*\]", plan)]
    assert leads and all("__sub" in m for m in leads)


@pytest.mark.parametrize("name", ["not_in", "not_in_with_null", "or_join", "daily_counts_dense",
                                  "running_total", "three_feed_union",
                                  "cells_daily", "packets_daily", "packets_daily_category_columns", "plant_trace",
                                  "packet_trace", "event_running_totals"])
def test_no_nested_loop_or_cartesian(spark, name):
    plan = plan_of(E.queries()[name](spark, SF))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_seed_check_aggregates_before_joining(spark):
    plan = plan_of(E.queries()["seed_check"](spark, SF))
    join_at = plan.find("Join")
    assert join_at >= 0
    # the partial sum of requests sits below (after, in the text) the join
    assert "partial_sum(l_quantity" in plan[join_at:]


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(E.queries()["plots_processed_daily"](spark, SF))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert set(x.split(":")[0] for x in schema.split(",")) == {"ts", "user_id", "event_type"}
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan).group(1)
    assert "event_type" in pushed


def test_zero_fill_builds_on_the_aggregated_facts(spark):
    plan = plan_of(E.queries()["daily_counts_faithful"](spark, SF))
    # the preserved calendar streams; the pre-aggregated facts are the build side
    assert "LeftOuter, BuildRight" in plan
