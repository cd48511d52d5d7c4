"""What the plans must look like, whatever the data size."""

import re
from pathlib import Path

import registry
from conftest import SF, plan_of
from gristmill.operators import cross, groups, narrowing, numeric
from registry.tables import table

ROOT = Path(__file__).resolve().parents[1]


def _scans(plan):
    return len(re.findall(r"FileScan parquet", plan))


def test_profile_reads_the_source_once_per_slice(spark):
    lines = table(spark, SF, "lineitem")
    plan = plan_of(numeric.num_profile(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
    assert _scans(plan) == 1
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_tax:double>" in plan


def test_base_and_plain_stats_read_the_source_once(spark):
    lines = table(spark, SF, "lineitem")
    assert _scans(plan_of(numeric.base_stats(lines, ["l_quantity", "l_tax"]))) == 1
    assert _scans(plan_of(numeric.plain_stats(lines, ["l_quantity", "l_tax"]))) == 1


def test_quantile_passes_shuffle_buckets_not_values(spark):
    rows = narrowing.tall(table(spark, SF, "lineitem"), ["l_extendedprice"])
    first = narrowing._first_pass(rows, [0.5])
    for step in (first, narrowing._next_pass(rows, first)):
        plan = plan_of(step)
        assert "partial_count" in plan
        keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
        assert keys and not any(re.search(r"\bx#", k) for k in keys), keys


def test_group_medians_read_the_source_once(spark):
    plan = plan_of(groups.group_medians(table(spark, SF, "events"), ["value"], "user_id"))
    assert _scans(plan) == 1


def test_pairs_are_counted_once(spark):
    orders = table(spark, SF, "orders")
    plan = plan_of(cross.cross_coverage(cross.pair_counts(orders, [["o_orderstatus", "o_orderpriority"]])))
    assert "orders.parquet" not in plan  # the dealt counts alone are read


def test_lookup_joins_follow_the_size_of_the_table(spark):
    orders = table(spark, SF, "orders")
    assert "BroadcastHashJoin" in plan_of(groups.group_aggregates(orders, orders, "o_custkey", "o_totalprice"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        assert "SortMergeJoin" in plan_of(groups.group_aggregates(orders, orders, "o_custkey", "o_totalprice"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rank_limits_run_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(registry.all_queries()["history_topk_per_task"](spark, SF))


def test_library_never_collects_rows_or_breaks_lineage_locally():
    # the corpus operators have a rule of their own, beside their tests
    for path in (p for p in (ROOT / "gristmill").rglob("*.py") if "llm" not in p.parts):
        text = path.read_text()
        assert not re.search(r"\.collect\(\)|toPandas|localCheckpoint|crossJoin|\.rdd\b|pandas_udf|\budf\(", text), path
