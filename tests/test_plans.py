"""What the plans of the queries must and must not contain."""

from __future__ import annotations

import pytest

from reportloom.operators import contracts
from reportloom.plans.catalog import QUERIES, declared_lines
from reportloom.plans.feeds import LINE_FEED


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python_in_the_plan(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval"):
        assert word not in plan, word


def test_period_filter_reaches_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["full_period_only"](spark, sf_dir))
    assert "LessThan(l_shipdate,1998-06-01T00:00)" in plan


def test_scan_reads_only_the_columns_in_use(spark, sf_dir):
    plan = plan_of(QUERIES["region_month_report"](spark, sf_dir))
    assert (
        "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double,"
        "l_shipdate:timestamp_ntz>" in plan
    )


def test_own_filter_is_applied_below_the_aggregate(spark, sf_dir):
    plan = plan_of(QUERIES["filter_period"](spark, sf_dir))
    optimized = plan[plan.index("== Optimized") : plan.index("== Physical")]
    assert optimized.rindex("Aggregate") < optimized.index("1998-03-01")


def test_violations_read_their_feed_once_per_shuffle(spark, sf_dir):
    df = contracts.violations(declared_lines(spark, sf_dir), LINE_FEED)
    df.collect()
    assert plan_of(df).count("ReusedExchange") >= 2


def formatted(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_dimensions_are_broadcast_in_a_chain(spark, sf_dir):
    """The fact is not shuffled for dimensions that fit; the one exchange is the report's."""
    plan = formatted(QUERIES["wide_left"](spark, sf_dir))
    assert plan.count("BroadcastHashJoin") == 4 and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_large_dimensions_are_joined_among_themselves_first(spark, sf_dir):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, "-1")
        rows = sorted(map(tuple, QUERIES["wide_left"](spark, sf_dir).collect()))
        plan = formatted(QUERIES["wide_left"](spark, sf_dir))
    finally:
        for n, value in zip(names, before):
            spark.conf.set(n, value)
    assert plan.count("SortMergeJoin") == 4
    # Only one of the four joins has the fact as its left side.
    assert sum("order_key" in line for line in plan.splitlines() if "SortMergeJoin" in line) == 1
    assert rows == sorted(map(tuple, QUERIES["wide_left"](spark, sf_dir).collect()))


def test_required_cells_are_worked_out_once(spark, sf_dir):
    plan = plan_of(QUERIES["typed_staging"](spark, sf_dir))
    optimized = plan[plan.index("== Optimized") : plan.index("== Physical")]
    # The slashed days of the feed; the other two are those of the report.
    assert optimized.count("yyyy/M/d, Some(UTC))") == 1


def test_a_profile_counts_its_table_once(spark, sf_dir):
    df = QUERIES["infer_types"](spark, sf_dir)
    df.collect()
    assert formatted(df).split("Initial Plan")[0].count("ReusedExchange") >= 1


def test_salted_dimensions_are_joined_among_themselves_first(spark, sf_dir):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n) for n in names]
    expected = sorted(map(tuple, QUERIES["wide_left"](spark, sf_dir).collect()))
    try:
        for n in names:
            spark.conf.set(n, "-1")
        rows = sorted(map(tuple, QUERIES["wide_spread"](spark, sf_dir).collect()))
        plan = formatted(QUERIES["wide_spread"](spark, sf_dir))
    finally:
        for n, value in zip(names, before):
            spark.conf.set(n, value)
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert len(joins) == 4 and sum("__salt" in line for line in joins) == 2
    assert sum("order_key" in line for line in joins) == 1
    assert rows == expected
