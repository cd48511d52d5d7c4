"""Statistics per group: exact medians, and group features fit on train."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.roles import quoted
from gristmill.operators.counts import name_of, number_counts
from gristmill.operators.lookup import left_lookup
from gristmill.operators.quantiles import locate


def group_medians(
    df: DataFrame,
    columns: Sequence[str],
    group: str,
    keep_empty: bool = True,
    columns_per_scan: int | None = None,
) -> DataFrame:
    """``(feature, group, median)`` for every column and every non-null group.

    A group without values keeps a null median when ``keep_empty``. The median
    comes from value counts, so a group that holds a third of the table is
    spread over the cluster by value instead of being gathered in one task.
    """
    named = df.where(F.col(quoted(group)).isNotNull())
    counts = number_counts(named, columns, [group], columns_per_scan)
    # a present group is never null; saying so keeps join keys free of null checks
    counts = counts.withColumn("k0", F.coalesce("k0", F.lit("")))
    found = locate(counts, ["k0", "fid"], [0.5], few_keys=False)
    medians = found.quantiles([0.5], ["median"])
    if keep_empty:
        medians = found.with_summary(medians)
    return medians.select(
        name_of(columns, F.col("fid")).alias("feature"), F.col("k0").alias("group"), "median"
    )


def group_table(df: DataFrame, key: str, value: str, prefix: str) -> DataFrame:
    """``(key, <prefix>_mean, _std, _count)`` of the non-null values per key."""
    v = F.col(quoted(value))
    return (
        df.where(F.col(quoted(key)).isNotNull())
        .groupBy(F.col(quoted(key)).alias(key))
        .agg(
            F.avg(v).alias(f"{prefix}_mean"),
            F.stddev_samp(v).alias(f"{prefix}_std"),
            F.count(v).alias(f"{prefix}_count"),
        )
    )


def group_aggregates(train: DataFrame, target: DataFrame, key: str, value: str) -> DataFrame:
    """``target`` with mean, deviation and count of ``value`` per ``key``, fit on ``train``."""
    return left_lookup(target, group_table(train, key, value, f"{key}_{value}"), [key])


def group_size(df: DataFrame, key: str) -> DataFrame:
    named = df.where(F.col(quoted(key)).isNotNull())
    return named.groupBy(F.col(quoted(key)).alias(key)).agg(F.count(F.lit(1)).alias("group_size"))


def group_nunique(df: DataFrame, key: str, member: str) -> DataFrame:
    """Distinct members per key.

    Members are made distinct first, keyed by both columns, so a hot key is
    spread by member and repeats collapse before the shuffle.
    """
    pairs = df.where(F.col(quoted(key)).isNotNull()).select(quoted(key), quoted(member)).distinct()
    return pairs.groupBy(F.col(quoted(key)).alias(key)).agg(F.count(F.col(quoted(member))).alias("group_nunique"))


def ratio_to_group_mean(train: DataFrame, target: DataFrame, key: str, value: str, output: str) -> DataFrame:
    """Row value over its group's train mean; null for unknown groups and zero means."""
    means = group_table(train, key, value, "_g").select(quoted(key), "_g_mean")
    joined = left_lookup(target, means, [key])
    return joined.withColumn(output, F.try_divide(F.col(quoted(value)).cast("double"), "_g_mean")).drop("_g_mean")
