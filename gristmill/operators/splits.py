"""Train/validation splits. None of them moves a row between machines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.hashing import bucket_of
from gristmill.functions.roles import quoted
from gristmill.functions.scalars import clock_micros
from gristmill.operators import numeric


def temporal(df: DataFrame, moment: str, train_share: float = 0.8, output: str = "split") -> DataFrame:
    """Rows up to the exact ``train_share`` quantile of time train, later ones validate."""
    timed = df.withColumn("_t", clock_micros(F.col(quoted(moment)), df.schema[moment].dataType))
    cut = numeric.quantiles(timed.select("_t"), ["_t"], [train_share], ["cut"]).select("cut").scalar()
    return timed.withColumn(output, F.when(F.col("_t") <= cut, F.lit("train")).otherwise(F.lit("valid"))).drop("_t")


def grouped(df: DataFrame, group: str, buckets: int = 5, held_out: int = 0, output: str = "split") -> DataFrame:
    """Whole groups go to one side."""
    held = bucket_of(F.col(quoted(group)), buckets) == held_out
    return df.withColumn(output, F.when(held, F.lit("valid")).otherwise(F.lit("train")))


def kfold(df: DataFrame, row_key: str, folds: int = 5, output: str = "fold") -> DataFrame:
    return df.withColumn(output, bucket_of(F.col(quoted(row_key)), folds))
