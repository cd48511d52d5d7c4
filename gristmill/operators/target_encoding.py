"""Target means per category that never see the row they describe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.hashing import bucket_of
from gristmill.functions.roles import quoted
from gristmill.operators.lookup import left_lookup

FOLDS = 5


def _fold_sums(train: DataFrame, category: str, target: str) -> DataFrame:
    """``(category, _fold, _s, _n)`` over rows with a category and a target.

    The only pass over the rows; everything later works on this table, which
    has at most one row per category and fold.
    """
    y = F.col(quoted(target)).cast("double")
    return (
        train.where(F.col(quoted(category)).isNotNull())
        .groupBy(quoted(category), "_fold")
        .agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    )


def out_of_fold(
    train: DataFrame,
    category: str,
    target: str,
    row_key: str,
    output: str,
    folds: int = FOLDS,
    smoothing: float | None = None,
) -> DataFrame:
    """Mean target of the row's category in the other folds.

    Without ``smoothing`` a category missing from the other folds stays null.
    With it, ``(sum + m * prior) / (count + m)`` with the overall mean of the
    other folds as prior, so the row's own target never counts. Missing
    categories are null. Folds come from a stable hash of ``row_key``.
    """
    y = F.col(quoted(target)).cast("double")
    marked = train.withColumn("_fold", bucket_of(F.col(quoted(row_key)), folds))
    per_category = Window.partitionBy(quoted(category))
    others = _fold_sums(marked, category, target).select(
        quoted(category),
        "_fold",
        (F.sum("_s").over(per_category) - F.coalesce("_s", F.lit(0.0))).alias("_os"),
        (F.sum("_n").over(per_category) - F.col("_n")).alias("_on"),
    )
    if smoothing is None:
        others = others.withColumn("_te", F.try_divide("_os", "_on"))
    else:
        # one row per fold: bounded by the number of folds
        by_fold = marked.groupBy("_fold").agg(F.coalesce(F.sum(y), F.lit(0.0)).alias("_fs"), F.count(y).alias("_fn"))
        alone = F.array_agg(F.struct("_fold", "_fs", "_fn"))
        total = by_fold.agg(alone.alias("_all")).select("_all", F.explode("_all").alias("_one"))
        prior = total.select(
            F.col("_one._fold").alias("_fold"),
            F.try_divide(
                F.aggregate("_all", F.lit(0.0), lambda a, e: a + e["_fs"]) - F.col("_one._fs"),
                F.aggregate("_all", F.lit(0).cast("bigint"), lambda a, e: a + e["_fn"]) - F.col("_one._fn"),
            ).alias("_prior"),
        )
        m = F.lit(float(smoothing))
        others = others.join(F.broadcast(prior), "_fold").withColumn(
            "_te", F.try_divide(F.coalesce("_os", F.lit(0.0)) + m * F.col("_prior"), F.col("_on") + m)
        )
    table = others.select(quoted(category), "_fold", F.col("_te").alias(output))
    return left_lookup(marked, table, [category, "_fold"]).select(*[quoted(c) for c in train.columns], quoted(output))


def on_test(train: DataFrame, test: DataFrame, category: str, target: str, output: str) -> DataFrame:
    """Test rows take the whole-train mean; unseen categories the overall mean."""
    y = F.col(quoted(target)).cast("double")
    table = train.groupBy(quoted(category)).agg(F.avg(y).alias("_te")).where(F.col(quoted(category)).isNotNull())
    overall = train.agg(F.avg(y)).scalar()
    return left_lookup(test, table, [category]).withColumn(output, F.coalesce("_te", overall)).drop("_te")


def count_encode(train: DataFrame, target: DataFrame, category: str, output: str) -> DataFrame:
    """How often the row's category occurs in train; 0 when it does not."""
    table = (
        train.where(F.col(quoted(category)).isNotNull())
        .groupBy(quoted(category))
        .agg(F.count(F.lit(1)).alias("_seen"))
    )
    return left_lookup(target, table, [category]).withColumn(output, F.coalesce("_seen", F.lit(0))).drop("_seen")
