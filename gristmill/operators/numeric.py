"""Numeric profile: one row per column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.roles import quoted
from gristmill.operators import narrowing
from gristmill.operators.counts import name_of, number_counts
from gristmill.operators.quantiles import Located, locate

# The reported quantiles and their names.
QUANTILES = [0.01, 0.10, 0.25, 0.50, 0.75, 0.90, 0.99]
QUANTILE_NAMES = ["P1", "P10", "P25", "P50", "P75", "P90", "P99"]

PROFILE_COLUMNS = [
    "feature", "nunique", "null_count", "null_ratio", "zero_count", "zero_ratio",
    "mean", "median", "std", "min", "max", *QUANTILE_NAMES,
]


def _locate(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    columns_per_scan: int | None,
    moments: bool = False,
) -> Located:
    counts = number_counts(df, columns, columns_per_scan=columns_per_scan)
    return locate(counts, ["fid"], probabilities, few_keys=True, moments=moments)


def _named(result: DataFrame, columns: Sequence[str]) -> DataFrame:
    return result.withColumn("feature", name_of(columns, F.col("fid"))).drop("fid")


def _clipped(found: Located, marks: DataFrame) -> DataFrame:
    """Moments over the values inside ``[P1, P99]``, both ends included."""
    return found.moments(marks.selectExpr("fid", "P1 as first", "P50 as centre", "P99 as last"))


def _with_ratios(stats: DataFrame) -> DataFrame:
    derived = {
        "median": "P50",
        "null_ratio": "try_divide(null_count, total_rows)",
        "zero_ratio": "try_divide(zero_count, total_rows)",
    }
    return stats.selectExpr(*[f"{derived[c]} as {c}" if c in derived else c for c in PROFILE_COLUMNS])


def num_profile(df: DataFrame, columns: Sequence[str], columns_per_scan: int | None = None) -> DataFrame:
    """The full numeric profile. Ratios divide by all rows, nulls included."""
    found = _locate(df, columns, QUANTILES, columns_per_scan, moments=True)
    marks = found.quantiles(QUANTILES, QUANTILE_NAMES)
    return _with_ratios(_named(found.with_summary(marks, _clipped(found, marks)), columns))


def plain_stats(df: DataFrame, columns: Sequence[str], columns_per_scan: int | None = None) -> DataFrame:
    """The unclipped variant: mean and deviation over every value."""
    found = _locate(df, columns, QUANTILES, columns_per_scan, moments=True)
    marks = found.quantiles(QUANTILES, QUANTILE_NAMES)
    return _with_ratios(_named(found.with_summary(marks, found.moments()), columns))


def base_stats(df: DataFrame, columns: Sequence[str], columns_per_scan: int | None = None) -> DataFrame:
    """Null count, distinct count (null is a value), extremes, zero count and
    median per column. NaN counts as a value but never as an extreme."""
    found = _locate(df, columns, [0.5], columns_per_scan)
    stats = found.with_summary(found.quantiles([0.5], ["median"]))
    return _named(stats, columns).select(
        "feature", "null_count", "nunique", "min", "max", "zero_count", "median"
    )


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float] = tuple(QUANTILES),
    names: Sequence[str] = tuple(QUANTILE_NAMES),
    columns_per_scan: int | None = None,
) -> DataFrame:
    """Exact quantiles per column, a null for a column without values. No value is
    shuffled to be counted (``narrowing``)."""
    columns = list(columns)
    size = columns_per_scan or len(columns)
    parts = [
        _every(narrowing.quantiles(df, columns[k : k + size], probabilities, names), columns[k : k + size])
        for k in range(0, len(columns), size)
    ]
    return reduce(DataFrame.unionByName, parts).select("feature", *names)


def _every(found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All ``columns`` by name, with their row of ``found`` (by number) or nulls."""
    numbered = found.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("fid"))
    return _named(numbered.join(F.broadcast(found), "fid", "left"), columns)


def moments(df: DataFrame, columns: Sequence[str], columns_per_scan: int | None = None) -> DataFrame:
    """Outlier-clipped mean and deviation per column: over the values inside the exact
    ``[P1, P99]``, both ends included. One more pass after the quantiles, a row per
    column and task."""
    columns = list(columns)
    size = columns_per_scan or len(columns)
    parts = []
    for k in range(0, len(columns), size):
        part = columns[k : k + size]
        marks = narrowing.quantiles(df, part, [0.01, 0.5, 0.99], ["P1", "P50", "P99"])
        inside = narrowing.tall(df, part).join(F.broadcast(marks), "fid").where(F.col("x").between(F.col("P1"), F.col("P99")))
        # moved to the middle, so that large values do not swallow small differences
        moved = F.col("x") - F.col("P50")
        kept = inside.groupBy("fid").agg(
            (F.first("P50") + F.avg(moved)).alias("mean"), F.stddev_samp(moved).alias("std")
        )
        parts.append(_every(kept, part))
    return reduce(DataFrame.unionByName, parts).select("feature", "mean", "std")


def ratios(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null and zero ratio per column in one pass with no shuffle of rows.

    One wide aggregation: each task returns one row, whatever its input.
    """
    exprs = [F.count(F.lit(1)).alias("rows")]
    for number, name in enumerate(columns):
        c = F.col(quoted(name))
        exprs += [F.count_if(c.isNull()).alias(f"null{number}"), F.count_if(c == 0).alias(f"zero{number}")]
    entries = [
        F.struct(
            F.lit(name).alias("feature"),
            F.col(f"null{number}").alias("null_count"),
            F.col(f"zero{number}").alias("zero_count"),
        )
        for number, name in enumerate(columns)
    ]
    tall = df.agg(*exprs).select("rows", F.inline(F.array(*entries)))
    return tall.select(
        "feature",
        "null_count",
        F.try_divide("null_count", "rows").alias("null_ratio"),
        "zero_count",
        F.try_divide("zero_count", "rows").alias("zero_ratio"),
    )


def clip_to_range(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` lies in its own exact ``[P1, P99]``, ends included."""
    bounds = quantiles(df, [column], [0.01, 0.99], ["low", "high"])
    edges = bounds.select(F.struct("low", "high")).scalar()
    return df.where(F.col(quoted(column)).cast("double").between(edges["low"], edges["high"]))
