"""Exact quantiles of columns from bucket counts of the rows, by narrowing.

A value never has to travel to be counted: each pass over the rows counts them per
bucket, combined before the shuffle, so what is shuffled is bounded by the number of
buckets, not of values.

1. The first pass counts buckets of a monotone function of the value (1,024 buckets per
   power of two), with the least and greatest value of each. Running totals say which
   buckets hold the wanted ranks.
2. Each further pass looks at the rows inside those intervals alone, in 65,536 equal
   steps between their extremes, and narrows them. A double has 53 bits, so a few passes
   are enough for any distribution; most need none.
3. Once an interval holds few rows its values are counted one by one; one that holds a
   single value is known already.

The table of intervals has at most two rows for each column and wanted share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.roles import quoted
from gristmill.operators.lookup import settled
from gristmill.operators.quantiles import FINE_STEPS, bucket_of, inside, wanted_ranks

#: Rows of an interval whose values are counted one by one.
FEW_ROWS = 100_000


def tall(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(fid, x)``: the present values of the numbered columns as doubles."""
    cells = ", ".join(f"{i}, cast({quoted(c)} as double)" for i, c in enumerate(columns))
    return df.selectExpr(f"stack({len(columns)}, {cells}) as (fid, x)").where("x is not null")


def _chosen(counted: DataFrame, group: str, order: str) -> DataFrame:
    """The parts of each group that hold wanted ranks, as intervals."""
    # one row per bucket or step of a column, at most 65,536 in later passes
    return (
        counted.selectExpr("*", f"base + sum(rows) over (partition by fid, {group} order by {order} rows unbounded preceding) as end")
        .selectExpr("*", f"{inside('ranks', 'end', 'rows')} as held")
        .where("size(held) > 0")
        .selectExpr("fid", "low", "high", "rows", "end - rows as base", "valid", "held as ranks")
    )


def _first_pass(rows: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    buckets = (
        rows.selectExpr("fid", "x", f"{bucket_of('x')} as bucket")
        .groupBy("fid", "bucket")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("x").alias("low"), F.max("x").alias("high"))
    )
    ranked = buckets.selectExpr("*", "0L as base", "sum(rows) over (partition by fid) as valid")
    return _chosen(ranked.selectExpr("*", f"{wanted_ranks(probabilities)} as ranks"), "base", "bucket")


def _within(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    met = (F.col("fid") == F.col("of")) & F.col("x").between(F.col("low"), F.col("high"))
    return rows.join(F.broadcast(intervals.withColumnRenamed("fid", "of")), met).drop("of")


def _next_pass(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    width = f"floor((x - low) / (high - low) * {FINE_STEPS})"
    # at infinity and NaN there is nothing to divide: each is a step of its own
    step = f"case when isnan(x) then {FINE_STEPS + 2}L when isnan(high) or abs(high) = double('infinity') or abs(low) = double('infinity') then {FINE_STEPS + 1}L else {width} end"  # noqa: E501
    counted = (
        _within(rows, intervals.selectExpr("fid", "low", "high", "base", "valid", "ranks"))
        .selectExpr("fid", "x", "low as origin", "base", "valid", "ranks", f"{step} as step")
        .groupBy("fid", "origin", "step")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("x").alias("low"),
            F.max("x").alias("high"),
            *[F.first(c).alias(c) for c in ("base", "valid", "ranks")],
        )
    )
    return _chosen(counted, "origin", "step")


def _one_by_one(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """``(fid, valid, rank, x)`` of intervals of few rows."""
    counted = (
        _within(rows, intervals.selectExpr("fid", "low", "high", "base", "valid", "ranks"))
        .groupBy("fid", "low", "x")
        .agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("base", "valid", "ranks")])
    )
    return counted.selectExpr(
        "fid", "valid", "x", "n", "ranks",
        "base + sum(n) over (partition by fid, low order by x rows unbounded preceding) as end",
    ).selectExpr("fid", "valid", f"explode({inside('ranks', 'end', 'n')}) as rank", "x")


def quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], names: Sequence[str], few_rows: int = FEW_ROWS
) -> DataFrame:
    """``(fid, <names>)`` per column that has values, linear interpolation; NaN sorts last.

    The passes run when this is called; the result reads their small table.
    """
    rows = tall(df, columns)
    found = []
    left = settled(_first_pass(rows, probabilities))
    while True:
        # not below another extreme: one value, whether or not it is a number
        single = "low <=> high"
        found.append(left.where(single).selectExpr("fid", "valid", "explode(ranks) as rank", "low as x"))
        few = left.where(f"not ({single}) and rows <= {few_rows}")
        many = left.where(f"not ({single}) and rows > {few_rows}")
        if not few.isEmpty():
            found.append(settled(_one_by_one(rows, few)))
        if many.isEmpty():
            break
        left = settled(_next_pass(rows, many))
    picked = found[0]
    for other in found[1:]:
        picked = picked.unionByName(other)
    at = picked.groupBy("fid").agg(F.first("valid").alias("valid"), F.expr("map_from_entries(collect_list(struct(rank, x)))").alias("at"))
    cells = []
    for probability, name in zip(probabilities, names, strict=True):
        place = f"({float(probability)!r}D * (valid - 1))"
        low, high = (f"at[cast({side}({place}) as bigint)]" for side in ("floor", "ceil"))
        cells.append(f"case when {low} = {high} then {low} else {low} + ({high} - {low}) * ({place} - floor({place})) end as `{name}`")
    return settled(at.selectExpr("fid", *cells))
