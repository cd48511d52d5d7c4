import collections
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gristmill.operators import binning, encode, groups, impute, leakage, splits, target_encoding, timeline
from gristmill.plans import feature_job


def test_fit_sees_train_only(spark):
    train = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 5.0, "b"), (4, 9.0, "a")], "k int, x double, c string")
    test = spark.createDataFrame([(5, None, None), (6, 1000.0, "z")], "k int, x double, c string")
    fitted = impute.fit(train, ["k", "x", "c"])
    got = {r.k: (r.x, r.c) for r in impute.apply(test, fitted, ["k", "x", "c"]).collect()}
    assert got == {5.0: (5.0, "a"), 6.0: (1000.0, "z")}  # the tie between a and b goes to a


def test_all_null_column_stays(spark):
    train = spark.createDataFrame([(1, None), (2, None)], "k int, x double")
    assert [r.x for r in impute.apply(train, impute.fit(train, ["k", "x"]), ["k", "x"]).collect()] == [None, None]


def test_feature_job_keeps_the_target_apart(spark):
    train = spark.createDataFrame([(1, 10.0, True, 7.0), (3, None, None, 8.0)], "k int, x double, flag boolean, y double")
    test = spark.createDataFrame([(9, None, None, 1)], "k int, x double, flag boolean, extra int")
    done, tested = feature_job.impute_and_row_mean(train, test, "y")
    assert done.columns == ["k", "x", "flag", "row_mean", "y"] and tested.columns == ["k", "x", "flag", "row_mean"]
    assert {(r.k, r.x, r.flag, r.row_mean, r.y) for r in done.collect()} == {
        (1.0, 10.0, True, 5.5, 7.0),
        (3.0, 10.0, True, 6.5, 8.0),
    }
    assert tested.first().x == 10.0 and tested.first().flag is True


def _series(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(1500):
        group = None if rng.random() < 0.05 else ("hot" if rng.random() < 0.5 else f"g{rng.randrange(30)}")
        stamp = rng.choice((rng.randrange(100), rng.randrange(10**6)))  # dense start, long tail
        rows.append((i, group, 1_700_000_000 + stamp, None if rng.random() < 0.2 else rng.random()))
    return rows


@pytest.mark.parametrize("rows_per_segment", [1, 10, 200, 10**6])
def test_past_features_match_a_plain_walk(spark, rows_per_segment):
    rows = _series(rows_per_segment)
    df = spark.createDataFrame(rows, "id int, g string, s bigint, x double").withColumn("t", F.timestamp_seconds("s"))
    got = {
        r.id: (r.x_lag1, r.x_lag3, r.x_roll7)
        for r in timeline.past_features(
            df, "g", "t", "id", "x", lags=[1, 3], windows=[7], rows_per_segment=rows_per_segment
        ).collect()
    }
    seen = collections.defaultdict(list)  # values of a group so far
    wanted = {}
    for i, g, _, x in sorted(rows, key=lambda r: (r[2], r[0])):
        past = seen[g] if g is not None else []
        recent = [p for p in past[-7:] if p is not None]
        wanted[i] = (past[-1] if past else None, past[-3] if len(past) >= 3 else None, sum(recent) / len(recent) if recent else None)
        if g is not None:
            seen[g].append(x)
    assert len(got) == len(rows)
    for i, values in wanted.items():
        assert got[i] == pytest.approx(values) if None not in values else all(
            (a is None) == (b is None) and (a is None or a == pytest.approx(b)) for a, b in zip(got[i], values, strict=True)
        )


@pytest.mark.parametrize("values", [list(range(97)), [1, 1, 1, 1, 1, 2, 3, 4, 5, 6], [0.5] * 30 + list(range(20)), [3.0]])
def test_qcut_matches_pandas(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(-1, None)], "i int, x double")
    got = {r.i: r.b for r in binning.qcut(df, "x", "b").collect()}
    assert got.pop(-1) is None
    if len(set(values)) == 1:
        assert set(got.values()) == {0}
        return
    expected = pd.qcut(pd.Series([float(v) for v in values]), q=10, labels=False, duplicates="drop")
    assert [got[i] for i in range(len(values))] == expected.tolist()


def test_out_of_fold_never_uses_its_own_row(spark):
    rows = [(i, "solo" if i == 7 else "ab"[i % 2], float(i)) for i in range(40)] + [(99, None, 5.0)]
    df = spark.createDataFrame(rows, "k int, c string, y double")
    plain = {r.k: r.te for r in target_encoding.out_of_fold(df, "c", "y", "k", "te").collect()}
    smooth = {r.k: r.te for r in target_encoding.out_of_fold(df, "c", "y", "k", "te", smoothing=10).collect()}
    assert plain[7] is None and plain[99] is None and smooth[99] is None
    moved = df.withColumn("y", F.when(F.col("k") == 7, F.lit(1e6)).otherwise(F.col("y")))
    again = {r.k: r.te for r in target_encoding.out_of_fold(moved, "c", "y", "k", "te", smoothing=10).collect()}
    assert again[7] == smooth[7]


def test_unseen_category(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 8.0)], "c string, y double")
    test = spark.createDataFrame([("a",), ("new",), (None,)], "c string")
    te = {r.c: r.te for r in target_encoding.on_test(train, test, "c", "y", "te").collect()}
    assert te == {"a": 2.0, "new": 4.0, None: 4.0}
    seen = {r.c: r.n for r in target_encoding.count_encode(train, test, "c", "n").collect()}
    assert seen == {"a": 2, "new": 0, None: 0}
    joined = {r.c: r.c_y_mean for r in groups.group_aggregates(train, test, "c", "y").collect()}
    assert joined == {"a": 2.0, "new": None, None: None}


def test_encode_apply_uses_the_pair_map_other(spark):
    encoding = spark.createDataFrame([("b", "x", 0), ("b", "OTH", 7)], "feature string, value string, id bigint")
    df = spark.createDataFrame([("x",), ("y",), (None,)], "b string")
    got = {r.b: r.i for r in encode.encode_apply(df, encoding, "b", "i").collect()}
    assert got == {"x": 0, "y": 7, None: 7}


def test_shared_rows_treat_null_as_a_value(spark):
    one = spark.createDataFrame([("a", None), ("b", 1), ("a", None)], "s string, n int")
    two = spark.createDataFrame([("a", None), ("c", 1)], "s string, n int")
    assert [tuple(r) for r in leakage.shared_rows(one, two).collect()] == [("a", None)]


def test_splits(spark):
    df = spark.range(1000).selectExpr("id", "id % 37 as g", "timestamp_seconds(id * 60) as t")
    folds = splits.kfold(df, "id").groupBy("fold").count().collect()
    assert {r.fold for r in folds} == set(range(5)) and sum(r["count"] for r in folds) == 1000
    sides = splits.grouped(df, "g").groupBy("g").agg(F.count_distinct("split").alias("n")).collect()
    assert {r.n for r in sides} == {1}
    timed = splits.temporal(df, "t").groupBy("split").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"))
    got = {r.split: r for r in timed.collect()}
    assert got["train"].b < got["valid"].a and got["train"].n == 800


def test_correlation_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.random(200), rng.random(200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    assert leakage.target_correlation(df, ["x"], "y").first().correlation == pytest.approx(np.corrcoef(x, y)[0, 1])


def test_clock_does_not_depend_on_the_session_zone(spark):
    from gristmill.functions.scalars import clock_micros

    df = spark.sql("select timestamp_ntz'2024-03-31 02:30:00.123456' as t union all select timestamp_ntz'1969-12-31 23:59:59.5'")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = {r.m for r in df.select(clock_micros(F.col("t"), df.schema["t"].dataType).alias("m")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == {1711852200123456, -500000}


def test_names_with_dots_and_blanks(spark):
    rows = [("a", 1.0, 1), ("a", 3.0, 2), ("b", 5.0, 3), (None, 7.0, 4)]
    df = spark.createDataFrame(rows, "`g.x` string, `v y` double, `r.k` long")
    assert {r["g.x"]: r["group_size"] for r in groups.group_size(df, "g.x").collect()} == {"a": 2, "b": 1}
    assert {r["g.x"]: r["group_nunique"] for r in groups.group_nunique(df, "g.x", "v y").collect()} == {"a": 2, "b": 1}
    assert {r["r.k"]: r["g.x_v y_mean"] for r in groups.group_aggregates(df, df, "g.x", "v y").collect()} == {1: 2.0, 2: 2.0, 3: 5.0, 4: None}
    assert {r["r.k"]: r["q"] for r in groups.ratio_to_group_mean(df, df, "g.x", "v y", "q").collect()} == {1: 0.5, 2: 1.5, 3: 1.0, 4: None}
    for smoothing in (None, 2.0):
        made = target_encoding.out_of_fold(df, "g.x", "v y", "r.k", "t.e", smoothing=smoothing)
        assert made.columns == [*df.columns, "t.e"] and made.count() == 4
    past = timeline.past_features(df.withColumn("t.s", F.timestamp_seconds("`r.k`")), "g.x", "t.s", "r.k", "v y", lags=[1])
    assert {r["r.k"]: r["v y_lag1"] for r in past.collect()} == {1: None, 2: 1.0, 3: None, 4: None}
