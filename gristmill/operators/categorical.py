"""Categorical profile: counts per column and its most frequent values."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.counts import text_counts
from gristmill.operators.lookup import settled
from gristmill.operators.spread import running_sums

# Values kept at least, and the share of all rows to cover.
MIN_ITEMS = 30
COVERAGE = 0.95


def cat_base(counts: DataFrame) -> DataFrame:
    """``(feature, total_rows, null_count, nunique)``; null is one of the values."""
    return counts.groupBy("feature").agg(
        F.sum("n").alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count(F.lit(1)).alias("nunique"),
    )


def cuts(
    counts: DataFrame, base: DataFrame, coverage: float = COVERAGE, min_items: int = MIN_ITEMS, max_items: int | None = None
) -> DataFrame:
    """``(feature, total_rows, keep, least)``: how many of a column's values are kept, and
    the smallest count among them.

    Values of one count are a class; a column of N rows has fewer than sqrt(2 N)
    classes. Running totals over the classes find the class in which the cut falls, and
    how many of its values are kept, without looking at single values.
    """
    numerator, denominator = Decimal(str(coverage)).as_integer_ratio()
    classes = counts.where(F.col("value").isNotNull()).groupBy("feature", "n").agg(F.count(F.lit(1)).alias("values"))
    higher = Window.partitionBy("feature").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    seen = classes.select(
        "feature",
        "n",
        "values",
        F.coalesce(F.sum("values").over(higher), F.lit(0)).alias("rank"),
        F.coalesce(F.sum(F.col("values") * F.col("n")).over(higher), F.lit(0)).alias("rows"),
    ).join(F.broadcast(base.select("feature", "total_rows")), "feature")
    # values of the class that begin below the coverage: rows + j n < coverage * total
    short = F.expr(f"({numerator} * total_rows - {denominator} * rows + {denominator} * n - 1) div ({denominator} * n)")
    room = F.greatest(F.lit(min_items) - F.col("rank"), short)
    if max_items is not None:
        room = F.least(room, F.lit(max_items) - F.col("rank"))
    kept = F.greatest(F.lit(0), F.least("values", room))
    return (
        seen.withColumn("kept", kept)
        .where("kept > 0")
        .groupBy("feature", "total_rows")
        .agg(F.sum("kept").alias("keep"), F.min("n").alias("least"))
    )


def top_values(
    counts: DataFrame,
    base: DataFrame,
    max_distinct: int | None = None,
    max_items: int | None = None,
    coverage: float = COVERAGE,
    min_items: int = MIN_ITEMS,
) -> DataFrame:
    """``(feature, value, rank, count, ratio, total_rows)``, most frequent first.

    It ends once ``min_items`` are kept and ``coverage`` of all rows is covered, the
    crossing value included. Ties go to the smaller value. All values up to there are
    kept, however many, unless the caller asks for at most ``max_items``, or for none
    from columns with more than ``max_distinct`` values.

    The number to keep comes from ``cuts``; only values that reach its smallest count
    are ordered, dealt by ranges, so no task holds all values of a column.
    """
    if max_distinct is not None:
        base = base.where(F.col("nunique") <= max_distinct)
    wanted = counts.where(F.col("value").isNotNull()).join(
        F.broadcast(cuts(counts, base, coverage, min_items, max_items)), "feature"
    ).where(F.col("n") >= F.col("least"))  # one row per column in the cuts
    ranked = running_sums(wanted, ["feature"], [F.desc("n"), F.col("value")], {"one": F.lit(1).cast("bigint")})
    return ranked.where(F.col("one_before") < F.col("keep")).select(
        "feature",
        "value",
        (F.col("one_before") + 1).alias("rank"),
        F.col("n").alias("count"),
        F.try_divide("n", "total_rows").alias("ratio"),
        "total_rows",
    )


def cat_profile(
    df: DataFrame,
    columns: Sequence[str],
    max_distinct: int | None = None,
    columns_per_scan: int | None = None,
    max_items: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(summary, top)``: one row per column, and its kept values. The value counts are
    written once and read for both."""
    counts = settled(text_counts(df, columns, columns_per_scan))
    base = cat_base(counts)
    top = top_values(counts, base, max_distinct, max_items)
    return summarise(base, top, max_distinct), top.drop("total_rows")


def summarise(base: DataFrame, top: DataFrame, max_distinct: int | None = None) -> DataFrame:
    kept = top.groupBy("feature").agg(
        F.try_divide(F.sum("count"), F.first("total_rows")).alias("coverage"), F.count(F.lit(1)).alias("items_kept")
    )
    skipped = F.lit(False) if max_distinct is None else F.col("nunique") > max_distinct
    return base.join(F.broadcast(kept), "feature", "left").select(
        "feature",
        "nunique",
        "null_count",
        F.try_divide("null_count", "total_rows").alias("null_ratio"),
        skipped.alias("skipped"),
        F.when(~skipped, F.coalesce("coverage", F.lit(0.0))).alias("coverage"),
        F.when(~skipped, F.coalesce("items_kept", F.lit(0))).alias("items_kept"),
    )
