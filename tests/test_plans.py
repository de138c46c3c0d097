"""What Spark makes of the queries: no plan may depend on tables being small."""

import re

import pytest

import __spark_entry__ as registry

FOLDER = "/root/testdata/sf0.001"
# The optional subpackage has its own tests.
QUERIES = {n: q for n, q in registry.queries().items() if not re.match(r"op\d+_|pipeline$", n)}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Round trips only report on what they wrote; their plans are those of the compared files.
@pytest.mark.parametrize("name", [n for n in QUERIES if not n.endswith("roundtrip")])
def test_no_pairwise_joins_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "SinglePartition"):
        if bad == "SinglePartition" and name in ONE_ROW:
            continue
        assert bad not in plan, bad


# Global counts end in one row; their inputs are reduced to one row per task first. The generator
# adds up one row for each of its product buckets, also where its values are only counted.
ONE_ROW = {
    "table_counts", "key_violations", "import_loaded", "gen_tickets", "gen_opportunities", "gen_distributions",
}


def test_date_windows_reach_the_scan(spark):
    plan = plan_of(QUERIES["slip_risk_flags"](spark, FOLDER))
    assert "GreaterThanOrEqual(o_orderdate,2000-02-01T00:00)" in plan
    assert "GreaterThanOrEqual(l_shipdate,2000-02-01T00:00)" in plan


def test_only_needed_columns_are_read(spark):
    plan = plan_of(QUERIES["opp_last_activity"](spark, FOLDER))
    assert re.findall(r"ReadSchema: (struct<[^>]*>)", plan) == [
        "struct<o_orderkey:bigint>",
        "struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>",
    ]


def test_top_rows_are_selected_before_the_shuffle(spark):
    plan = plan_of(QUERIES["customer_top_opps"](spark, FOLDER))
    assert re.search(r"WindowGroupLimit .*Partial", plan)
    assert "TakeOrderedAndProject" in plan_of(QUERIES["slip_risk_top10"](spark, FOLDER))


def test_facts_are_reduced_before_the_shuffle(spark):
    for name in ("opp_last_activity", "expansion_pipeline", "latest_csat", "orphan_rows", "sla_breaches"):
        plan = plan_of(QUERIES[name](spark, FOLDER))
        assert "partial_" in plan or "functions=[]" in plan, name


def test_edges_are_not_shuffled(spark):
    assert "Exchange" not in plan_of(QUERIES["edges"](spark, FOLDER))


def test_policies_are_broadcast_by_their_known_size(spark):
    plan = plan_of(QUERIES["policy_sweep"](spark, FOLDER))
    assert "LocalTableScan [policy_id" in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 1 << 16)
    try:
        assert "BroadcastHashJoin [close_month" in plan_of(QUERIES["policy_sweep"](spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_references_meet_their_parents_in_one_aggregate(spark):
    """No parent is broadcast or sorted to look its ids up, whatever its size."""
    for threshold in (-1, 1 << 30):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            plan = plan_of(QUERIES["orphan_rows"](spark, FOLDER))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "LeftAnti" not in plan and plan.count("Exchange hashpartitioning(missing_id") == 4
