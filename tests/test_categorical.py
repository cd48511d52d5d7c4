import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from gristmill.functions.roles import profile_roles
from gristmill.operators import categorical, cross, encode
from gristmill.operators.counts import text_counts
from gristmill.operators.spread import running_sums
from gristmill.plans import profile, report


def test_at_least_thirty_then_coverage(spark):
    # 40 values, the first covers 96% alone: thirty are kept all the same
    rows = [("v00",)] * 960 + [(f"v{i:02d}",) for i in range(1, 41)]
    summary, top = categorical.cat_profile(spark.createDataFrame(rows, "x string"), ["x"])
    kept = top.orderBy("rank").collect()
    assert len(kept) == 30 and kept[0]["value"] == "v00" and kept[1]["value"] == "v01"
    assert summary.first().items_kept == 30


def test_stops_at_coverage_and_where_asked(spark):
    even = spark.range(2000).selectExpr("cast(id % 100 as string) as x")
    assert categorical.cat_profile(even, ["x"])[0].first().items_kept == 95
    many = spark.range(5000).selectExpr("cast(id as string) as x")
    got = categorical.cat_profile(many, ["x"])[0].first()
    assert got.items_kept == 4750 and got.coverage == 0.95
    got = categorical.cat_profile(many, ["x"], max_items=1000)[0].first()
    assert got.items_kept == 1000 and got.coverage == 0.2


def test_many_values_reach_the_coverage_without_a_window_over_all(spark):
    wide = spark.range(200_000).selectExpr("case when id % 3 = 0 then 'hot' else cast(id as string) end as x")
    summary, top = categorical.cat_profile(wide, ["x"])
    got = summary.first()
    assert got.nunique == 133_334 and got.items_kept == 123_334 and got.coverage == 0.95
    first = top.where("rank <= 3").orderBy("rank").collect()
    assert [(r.value, r["count"]) for r in first] == [("hot", 66_667), ("1", 1), ("10", 1)]
    assert top.agg(F.count_distinct("rank"), F.max("rank")).first() == (123_334, 123_334)
    # ranks run within a part of a column, never over a column
    windows = re.findall(r"windowspecdefinition\(([^)]*)", plan_of(top))
    assert windows and not any(w.startswith("feature") and "value" in w for w in windows)


@pytest.mark.parametrize("seed", range(4))
def test_cut_equals_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    values = [None if rng.random() < 0.03 else f"v{int(rng.paretovariate(0.5)) % 400}" for _ in range(3000)]
    frame = spark.createDataFrame([(v,) for v in values], "x string")
    got = [(r.value, r["rank"], r["count"]) for r in categorical.cat_profile(frame, ["x"])[1].orderBy("rank").collect()]
    counts = collections.Counter(v for v in values if v is not None)
    kept, before = [], 0
    for rank, (value, n) in enumerate(sorted(counts.items(), key=lambda kv: (-kv[1], kv[0])), 1):
        if rank <= 30 or before * 100 < 95 * len(values):
            kept.append((value, rank, n))
        before += n
    assert got == kept


def test_hot_a_value_is_spread_over_tasks(spark):
    pairs = spark.range(300_000).selectExpr(
        "case when id % 10 < 9 then 'hot' else cast(id % 7 as string) end as a", "cast(id div 2 as string) as b"
    )
    counts = cross.pair_counts(pairs, [["a", "b"]])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kept = cross.cross_coverage(counts)
        got = kept.groupBy("a").agg(F.count("*").alias("n"), F.max("rank").alias("last")).collect()
        dealt = running_sums(counts, ["pair", "a"], [F.desc("n"), F.col("b")], {"one": F.lit(1)})
        assert dealt.count() == counts.count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r.n == r["last"] for r in got) and {r.a for r in got} == {"hot", *"0123456"}


def test_running_sums_carry_over_partitions(spark):
    rows = [(g, k, float(k % 5)) for g, n in (("a", 1), (None, 700), ("b", 3000), ("c", 2)) for k in range(n)]
    frame = spark.createDataFrame(rows, "g string, k int, x double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running_sums(frame, ["g"], [F.col("k")], {"x": F.col("x"), "one": F.lit(1)}).collect()
        alone = running_sums(frame.where("g = 'b'").select("k"), [], [F.desc("k")], {"one": F.lit(1)}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums, sizes = collections.defaultdict(float), collections.Counter(g for g, _, _ in rows)
    wanted = {}
    for g, k, x in rows:
        wanted[g, k] = (sums[g], k)
        sums[g] += x
    assert len(got) == len(rows)
    assert {(r.g, r.k): (r.x_before, r.one_before) for r in got} == wanted
    assert all(r.x_total == sums[r.g] and r.one_total == sizes[r.g] for r in got)
    assert sorted((r.one_before, r.k) for r in alone) == [(i, 2999 - i) for i in range(3000)]
    assert running_sums(frame.where("false"), ["g"], [F.col("k")], {"one": F.lit(1)}).count() == 0


def test_nulls_count_in_the_denominator(spark):
    df = spark.createDataFrame([("a",), (None,), (None,), ("b",)], "x string")
    summary, top = categorical.cat_profile(df, ["x"])
    assert summary.first().nunique == 3 and summary.first().coverage == 0.5
    assert {(r.value, r["ratio"]) for r in top.collect()} == {("a", 0.25), ("b", 0.25)}


def test_all_null_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x string")
    summary, top = categorical.cat_profile(df, ["x"])
    assert summary.first().items_kept == 0 and summary.first().coverage == 0.0 and not top.collect()
    assert [(r.value, r.id) for r in encode.encoding_map(summary, top).collect()] == [("OTH", 0)]


def test_high_cardinality_is_flagged(spark):
    counts = text_counts(spark.range(50).selectExpr("cast(id as string) as x", "'k' as y"), ["x", "y"])
    base = categorical.cat_base(counts)
    top = categorical.top_values(counts, base, max_distinct=10)
    got = {r.feature: r for r in categorical.summarise(base, top, 10).collect()}
    assert got["x"].skipped and got["x"].items_kept is None and not got["y"].skipped


def test_real_other_value_gives_way(spark):
    rows = [("OTH",)] * 3 + [("a",)] * 2 + [("b",)]
    summary, top = categorical.cat_profile(spark.createDataFrame(rows, "x string"), ["x"])
    got = {r.value: r.id for r in encode.encoding_map(summary, top).collect()}
    assert got == {"OTH": 0, "a": 2, "b": 3}


def test_separator_inside_values_keeps_pairs_apart(spark):
    df = spark.createDataFrame([("a::b", "c"), ("a", "b::c")], "x string, y string")
    counts = cross.pair_counts(df, [["x", "y"]])
    assert cross.combinations(counts).first().combinations == 2


def test_unknown_pairs_are_left_out(spark):
    df = spark.createDataFrame([("a", "c")], "x string, y string")
    assert cross.known_pairs(df, [["x", "y"], ["x", "nope"], ["x"]]) == [("x", "y")]


def test_cross_coverage_keeps_the_crossing_item(spark):
    rows = [("p", "x")] * 90 + [("p", "y")] * 6 + [("p", "z")] * 4 + [("q", "x")]
    got = cross.cross_coverage(cross.pair_counts(spark.createDataFrame(rows, "a string, b string"), [["a", "b"]]))
    assert {(r.a, r.b, r["ratio"]) for r in got.collect()} == {("p", "x", 0.9), ("p", "y", 0.06), ("q", "x", 1.0)}


def test_child_map_by_hand(spark):
    top = spark.createDataFrame([("a", "p", 1), ("a", "q", 2)], "feature string, value string, rank int")
    summary = spark.createDataFrame([("a",), ("b",)], "feature string")
    # q has the larger leading count, so it is seen first; r is unknown to the parent
    kept = spark.createDataFrame(
        [("a__x__b", "p", "x", 1, 5), ("a__x__b", "p", "y", 2, 4), ("a__x__b", "q", "y", 1, 9), ("a__x__b", "r", "z", 1, 99)],
        "pair string, a string, b string, rank int, count bigint",
    )
    maps = encode.encoding_maps(summary, top, ["a", "b"], kept, [("a", "b")])
    got = {r.value: r.id for r in maps["b"].collect()}
    assert got == {"y": 0, "x": 1, "q-OTH": 2, "p-OTH": 3, "OTH": 4}


def test_forced_and_skipped_roles(spark):
    df = spark.createDataFrame([], "k int, t timestamp, s string, b boolean, v double, l array<int>")
    roles = profile_roles(df, ["k"])
    assert roles.categorical == ["k", "s", "b"] and roles.numeric == ["v"] and roles.skipped == ["t", "l"]
    assert profile_roles(df, ["t"]).categorical == ["t", "s", "b"]


def test_summarize_with_forced_timestamp(spark):
    df = spark.sql("select timestamp'2024-01-01' as t, 1.5 as v union all select timestamp'2024-01-02', 2.5")
    done = profile.summarize(df, force_categorical=["t"])
    assert done.cat.first().nunique == 2 and done.num.first().P50 == 2.0 and done.cross is None


def test_drop_reasons(spark):
    num = spark.createDataFrame(
        [("a", 0.95, 1, 0.0), ("b", 0.0, 1, 1.0), ("c", 0.0, 5, 0.96), ("d", 0.9, 2, 0.95)],
        "feature string, null_ratio double, nunique bigint, zero_ratio double",
    )
    assert {r.feature: r.reason for r in report.drop_list(num).collect()} == {"a": "missing", "b": "constant", "c": "zeros"}
