"""Checks for information that a model should not have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.roles import quoted
from gristmill.operators.lookup import settled
from gristmill.operators.spread import running_sums


def shared_rows(train: DataFrame, test: DataFrame) -> DataFrame:
    """Distinct rows found on both sides (null equals null).

    First 256-bit digests and their sides alone are shuffled: copies collapse on the map
    side, so a row repeated across a third of the data costs no more than any other.
    Rows whose digest is on both sides are then compared as they are.
    """
    columns = [quoted(c) for c in train.columns]
    sides = [train.select(*columns, F.lit(1).alias("_side")), test.select(*columns, F.lit(2).alias("_side"))]
    row = F.struct(*columns)
    both = sides[0].unionByName(sides[1]).select(F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256).alias("_digest"), "_side", row.alias("_row"))
    ends = lambda *keys: (F.min("_side").alias("_low"), F.max("_side").alias("_high"), *keys)
    candidates = settled(both.groupBy("_digest").agg(*ends()).where("_low < _high").select("_digest"))
    met = both.join(candidates, "_digest", "left_semi")
    seen = met.groupBy("_digest").agg(*ends(F.min("_row").alias("_a"), F.max("_row").alias("_b")))
    alike = seen.where(F.col("_a").eqNullSafe(F.col("_b"))).select("_a.*")
    # different rows of one digest: told apart row by row
    clashing = seen.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("_digest")
    apart = met.join(clashing, "_digest", "left_semi").groupBy("_row").agg(*ends()).where("_low < _high").select("_row.*")
    return alike.unionByName(apart)


def target_correlation(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """``(feature, correlation, strength)`` in one pass, one row per task."""
    y = F.col(quoted(target)).cast("double")
    wide = df.agg(*[F.corr(F.col(quoted(c)).cast("double"), y).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("correlation")) for i, c in enumerate(columns)]
    return (
        wide.select(F.inline(F.array(*rows)))
        .withColumn("strength", F.abs("correlation"))
        .orderBy(F.desc("strength"), "feature")
    )


def _mean_ranks(values: DataFrame) -> DataFrame:
    """``(v, rank)`` of a column ``v``: places from 1, equal values share their mean place.

    Equal values are counted first; the counts are summed along ranges of values, so
    neither a very common value nor very many values meet in one task.
    """
    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    summed = running_sums(counts, [], [F.col("v")], {"n": F.col("n")})
    return summed.select("v", (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank"))


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """``(rank_correlation)``: the correlation of mean ranks over the rows where both
    columns are present; NaN ranks last. Null with fewer than two different values on
    either side."""
    pairs = df.select(F.col(quoted(x)).alias("x"), F.col(quoted(y)).alias("y"))
    pairs = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    x_ranks = settled(_mean_ranks(pairs.select(F.col("x").alias("v")))).select(F.col("v").alias("x"), F.col("rank").alias("x_rank"))
    y_ranks = settled(_mean_ranks(pairs.select(F.col("y").alias("v")))).select(F.col("v").alias("y"), F.col("rank").alias("y_rank"))
    # a value that fills much of the table makes the other side of its join small, or its partition is split
    return pairs.join(x_ranks, "x").join(y_ranks, "y").agg(F.corr("x_rank", "y_rank").alias("rank_correlation"))


def id_order(df: DataFrame, row_id: str, target: str) -> DataFrame:
    """Does the id itself carry order that the target follows? ``(id_column, correlation,
    rank_correlation)``: of the numbers, and of their mean ranks, which also shows an
    order that is not a straight line."""
    plain = target_correlation(df, [row_id], target).select(F.col("feature").alias("id_column"), "correlation")
    return plain.withColumn("rank_correlation", rank_correlation(df, row_id, target).scalar())


def encoding_gap(df: DataFrame, encoded: str, target: str, split: str = "split") -> DataFrame:
    """Correlation of an encoded feature with the target on either side of a
    split; near-perfect on train and poor on validation points to in-fold encoding."""
    x, y = F.col(quoted(encoded)).cast("double"), F.col(quoted(target)).cast("double")
    on_train, on_valid = F.col(quoted(split)) == "train", F.col(quoted(split)) == "valid"
    return df.agg(
        F.corr(F.when(on_train, x), F.when(on_train, y)).alias("train_correlation"),
        F.corr(F.when(on_valid, x), F.when(on_valid, y)).alias("valid_correlation"),
    ).withColumn("gap", F.col("train_correlation") - F.col("valid_correlation"))
