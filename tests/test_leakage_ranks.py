import re
import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from gristmill.operators import leakage


def mean_ranks(values):
    places = {}
    for k, v in enumerate(sorted(values), 1):
        places.setdefault(v, []).append(k)
    return [sum(places[v]) / len(places[v]) for v in values]


def correlation(x, y):
    mx, my = sum(x) / len(x), sum(y) / len(y)
    cov = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True))
    return cov / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5


def test_rank_correlation_with_ties_and_gaps(spark):
    rng = random.Random(2)
    rows = [(None if rng.random() < 0.1 else rng.randrange(300), None if rng.random() < 0.1 else rng.choice([0.0, 0.0, rng.random()])) for _ in range(2000)]
    frame = spark.createDataFrame(rows, "i int, y double")
    got = leakage.rank_correlation(frame, "i", "y").first().rank_correlation
    kept = [r for r in rows if None not in r]
    assert got == pytest.approx(correlation(*(mean_ranks(c) for c in zip(*kept, strict=True))))


def test_an_order_that_is_no_line_shows_in_the_ranks(spark):
    frame = spark.range(1, 200).select("id", F.exp(F.col("id") / 5).alias("y"))
    got = leakage.id_order(frame, "id", "y").first()
    assert got.rank_correlation == pytest.approx(1) and got.correlation < 0.5
    assert leakage.id_order(frame.where("id = 1"), "id", "y").first().rank_correlation is None
    assert leakage.id_order(frame.where("false"), "id", "y").first().rank_correlation is None


def test_shared_rows_compare_rows_not_only_digests(spark):
    left = spark.createDataFrame([("a", 1.5), ("a", 1.5), (None, None), ("b", 2.0), ("", None)], "t string, x double")
    right = spark.createDataFrame([("a", 1.5), (None, None), ("b", 2.5), (None, 2.0)], "t string, x double")
    assert sorted(map(str, leakage.shared_rows(left, right).collect())) == sorted(["Row(t='a', x=1.5)", "Row(t=None, x=None)"])
    plan = plan_of(leakage.shared_rows(left, right))
    assert not re.search(r"Exchange hashpartitioning\((t|x)#", plan)
    assert leakage.shared_rows(left.where("false"), right).count() == 0
