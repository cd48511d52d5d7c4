import math
import random
from decimal import Decimal

import numpy as np
import pytest

from gristmill.operators import groups, narrowing, numeric
from gristmill.operators.counts import number_counts
from gristmill.operators.quantiles import locate


def _profile(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return {r["feature"]: r for r in numeric.num_profile(df, df.columns).collect()}


def test_odd_columns(spark):
    rows = [(None, 7, 5), (None, None, 5), (None, 7, 5), (None, 7, 5)]
    got = _profile(spark, rows, "empty double, gappy int, fixed bigint")
    assert got["empty"].null_ratio == 1.0 and got["empty"].nunique == 1
    assert got["empty"].P50 is None and got["empty"]["mean"] is None and got["empty"]["min"] is None
    # null is one of the values
    assert got["gappy"].nunique == 2 and got["gappy"]["std"] == 0.0
    assert got["fixed"].nunique == 1 and got["fixed"].P1 == got["fixed"].P99 == 5.0


def test_single_row_has_no_deviation(spark):
    got = _profile(spark, [(3.5,)], "x double")["x"]
    assert got["mean"] == 3.5 and got["std"] is None and got.P10 == 3.5


def test_empty_table(spark):
    assert _profile(spark, [], "x double") == {}


def test_nan_and_infinity(spark):
    values = [1.0, 2.0, float("nan"), float("inf"), -float("inf"), 0.0, -0.0]
    got = _profile(spark, [(v,) for v in values], "x double")["x"]
    assert got.nunique == 6 and got.zero_count == 2
    assert got["min"] == -math.inf and got["max"] == math.inf
    assert got.P50 == 1.0  # NaN sorts last
    assert math.isnan(numeric.quantiles(spark.createDataFrame([(v,) for v in values], "x double"), ["x"], [1.0], ["q"]).first().q)


def test_large_whole_numbers_stay_distinct(spark):
    big = 2**53
    got = _profile(spark, [(big,), (big + 1,), (big + 2,)], "x bigint")["x"]
    assert got.nunique == 3


def test_decimals(spark):
    rows = [(Decimal("1.10"), Decimal("5")), (Decimal("1.20"), None), (Decimal("1.20"), Decimal("7"))]
    got = _profile(spark, rows, "a decimal(20,2), b decimal(5,0)")
    assert got["a"].nunique == 2 and got["a"].P50 == pytest.approx(1.2)
    assert got["b"].P50 == 6.0 and got["b"].nunique == 3


def _shapes():
    rng = random.Random(5)
    return {
        "normal": [rng.gauss(0, 1) for _ in range(3000)],
        "heavy": [rng.choice((-1, 1)) * math.exp(rng.uniform(-300, 300)) for _ in range(3000)],
        "narrow": [1e15 + rng.randrange(5000) / 8 for _ in range(3000)],
        "hot": [rng.choice((4.0, 4.0, rng.random())) for _ in range(3000)],
        "tiny": [rng.uniform(0, 5e-324 * 40) for _ in range(3000)],
        "ids": [float(rng.randrange(10**12)) for _ in range(3000)],
    }


@pytest.mark.parametrize("name", sorted(_shapes()))
def test_quantiles_and_moments_match_numpy(spark, name):
    values = _shapes()[name]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(7)
    got = numeric.num_profile(df, ["x"]).first()
    exact = np.quantile(values, numeric.QUANTILES)
    for wanted, column in zip(exact, numeric.QUANTILE_NAMES, strict=True):
        assert got[column] == pytest.approx(wanted, rel=1e-12, abs=1e-323)
    kept = np.array([v for v in values if got.P1 <= v <= got.P99])
    with np.errstate(over="ignore"):
        if np.isfinite(kept.std(ddof=1)):
            centred = kept - np.median(kept)
            assert got["mean"] == pytest.approx(np.median(kept) + centred.mean(), rel=1e-9)
            assert got["std"] == pytest.approx(centred.std(ddof=1), rel=1e-6, abs=1e-300)


@pytest.mark.parametrize("few_rows", [0, 50, 10**6])
@pytest.mark.parametrize("name", sorted(_shapes()))
def test_narrowing_matches_numpy_however_far_it_goes(spark, name, few_rows):
    values = _shapes()[name]
    df = spark.createDataFrame([(v, 7) for v in values], "x double, y int").repartition(7)
    got = {r.fid: r for r in narrowing.quantiles(df, ["x", "y"], numeric.QUANTILES, numeric.QUANTILE_NAMES, few_rows).collect()}
    for wanted, column in zip(np.quantile(values, numeric.QUANTILES), numeric.QUANTILE_NAMES, strict=True):
        assert got[0][column] == pytest.approx(wanted, rel=1e-12, abs=1e-323)
    assert set(got[1][1:]) == {7.0}


@pytest.mark.parametrize("few_rows", [0, 10**6])
def test_narrowing_of_infinities_and_nothing(spark, few_rows):
    inf, nan = float("inf"), float("nan")
    values = [-inf, -inf, -1.0, 0.0, 2.0, inf, inf, nan, nan, nan]
    df = spark.createDataFrame([(v, None) for v in values], "x double, y double")
    shares = [k / 9 for k in range(10)]
    names = [f"q{k}" for k in range(10)]
    got = narrowing.quantiles(df, ["x", "y"], shares, names, few_rows).collect()
    assert len(got) == 1
    for mine, wanted in zip(got[0][1:], values, strict=True):
        assert mine == wanted or (math.isnan(mine) and math.isnan(wanted))
    assert numeric.quantiles(df, ["y"], [0.5], ["m"]).collect()[0].m is None
    assert numeric.moments(df.where("false"), ["x"]).collect()[0]["mean"] is None


def test_result_does_not_depend_on_partitioning(spark):
    df = spark.range(2000).selectExpr("id % 613 * 1.5 as x", "id as y")
    first = sorted(map(tuple, numeric.num_profile(df.repartition(1), ["x", "y"]).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        again = sorted(map(tuple, numeric.num_profile(df.repartition(9), ["x", "y"]).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for a, b in zip(first, again, strict=True):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:])


def test_column_slices_agree(spark):
    df = spark.range(500).selectExpr("id as a", "id * 2.5 as b", "cast(id % 9 as int) as c", "cast(id as decimal(9,1)) as d")
    one = sorted(map(tuple, numeric.quantiles(df, df.columns, columns_per_scan=1).collect()))
    all_at_once = sorted(map(tuple, numeric.quantiles(df, df.columns, columns_per_scan=4).collect()))
    assert one == all_at_once


def test_group_medians(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", None), (None, 9.0), ("c", 2.0), ("c", 4.0), ("c", 9.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    kept = {(r.feature, r.group): r.median for r in groups.group_medians(df, ["x"], "g").collect()}
    assert kept == {("x", "a"): 2.0, ("x", "b"): None, ("x", "c"): 4.0}
    dropped = groups.group_medians(df, ["x"], "g", keep_empty=False).collect()
    assert {r.group for r in dropped} == {"a", "c"}


def test_hot_group_median_matches_numpy(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(50), rng.expovariate(0.01)) for _ in range(4000)]
    got = {r.group: r.median for r in groups.group_medians(spark.createDataFrame(rows, "g int, x double"), ["x"], "g").collect()}
    for g in {r[0] for r in rows}:
        assert got[str(g)] == pytest.approx(float(np.median([x for k, x in rows if k == g])))


def test_group_column_can_be_profiled_too(spark):
    df = spark.createDataFrame([(1, 2), (1, 4), (2, 6)], "g int, x int")
    got = {(r.feature, r.group): r.median for r in groups.group_medians(df, ["g", "x"], "g").collect()}
    assert got == {("g", "1"): 1.0, ("g", "2"): 2.0, ("x", "1"): 3.0, ("x", "2"): 6.0}


def test_located_ranks_are_never_ambiguous(spark):
    df = spark.createDataFrame([(2**53 + i,) for i in range(5)], "x bigint")
    found = locate(number_counts(df, ["x"]), ["fid"], [0.0, 0.5, 1.0], few_keys=True)
    assert len(found.picked.first()["at"]) == 3


def test_odd_names(spark):
    df = spark.createDataFrame([(1, 2.0), (3, 4.0)], "`a b` int, `c.d` double")
    got = {r.feature: r["P50"] for r in numeric.num_profile(df, df.columns).collect()}
    assert got == {"a b": 2.0, "c.d": 3.0}
