import random
import statistics

import pytest
from pyspark.sql import functions as F

from gristmill import scratch_path
from gristmill.operators import numeric, sketches
from gristmill.sources import files

COLUMNS = ["x", "k", "gone", "odd.name"]


def _table(spark, seed, n=20_000):
    rng = random.Random(seed)
    rows = [
        (
            None if rng.random() < 0.1 else float("nan") if rng.random() < 0.01 else rng.lognormvariate(0, 3),
            rng.randrange(3000),
            None,
            1e9 + rng.random(),
        )
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, "x double, k int, gone double, `odd.name` double"), rows


def _rank_error(values, got, p):
    """How far the place of ``got`` is from the wanted share."""
    below = sum(v < got for v in values) / len(values)
    upto = sum(v <= got for v in values) / len(values)
    return max(below - p, p - upto, 0.0)


def test_merged_parts_are_near_the_exact_profile(spark):
    df, rows = _table(spark, 1)
    parts = sketches.sketch(df, COLUMNS, F.pmod("k", F.lit(7)).cast("string"))
    got = {r["feature"]: r for r in sketches.profile(parts).collect()}
    for i, name in enumerate(COLUMNS):
        values = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        one = got[name]
        assert one["null_count"] == sum(r[i] is None for r in rows)
        if not values:
            assert one["P50"] is None and one["mean"] is None and one["std"] is None and one["nunique"] == 1
            continue
        assert (one["min"], one["max"]) == (min(values), max(values))
        assert one["mean"] == pytest.approx(statistics.fmean(values), rel=1e-9)
        assert one["std"] == pytest.approx(statistics.stdev(values), rel=1e-4)
        for p, n in zip(numeric.QUANTILES, numeric.QUANTILE_NAMES, strict=True):
            assert _rank_error(values, one[n], p) < 0.01
        distinct = len({str(r[i]) for r in rows})
        assert abs(one["nunique"] - distinct) <= 0.04 * distinct


def test_added_files_are_read_once(spark, tmp_path):
    data, store = tmp_path / "data", scratch_path(spark, "sketches")
    _table(spark, 1, 500)[0].coalesce(1).write.parquet(str(data / "a"))
    listed = files.list_files(spark, str(data))
    assert sketches.add_files(spark, listed, COLUMNS, store) == 1
    assert sketches.add_files(spark, listed, COLUMNS, store) == 0
    _table(spark, 2, 700)[0].repartition(3).write.parquet(str(data / "b"))
    grown = files.list_files(spark, str(data))
    with pytest.raises(ValueError):
        sketches.stored_profile(spark, grown, store)
    assert sketches.add_files(spark, grown, COLUMNS, store) == 3
    whole = {r["feature"]: r for r in sketches.stored_profile(spark, grown, store).collect()}
    assert whole["gone"]["null_count"] == 1200
    exact = {r["feature"]: r for r in numeric.base_stats(spark.read.parquet(*grown), ["k", "x"]).collect()}
    for name in ("k", "x"):
        assert all(whole[name][c] == exact[name][c] for c in ("null_count", "zero_count", "min", "max"))
    first = {r["feature"]: r for r in sketches.stored_profile(spark, listed, store).collect()}
    assert first["gone"]["null_count"] == 500


def test_no_rows(spark):
    empty = spark.createDataFrame([], "x double")
    assert sketches.profile(sketches.sketch(empty, ["x"])).count() == 0
