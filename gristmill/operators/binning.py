"""Quantile bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.roles import quoted
from gristmill.operators import numeric


def qcut(df: DataFrame, column: str, output: str, bins: int = 10) -> DataFrame:
    """Bin number 0.. from equal-count edges, right-closed, repeated edges merged.

    Edges are the exact quantiles of ``column``; null stays null.
    """
    names = [f"e{i}" for i in range(bins + 1)]
    marks = numeric.quantiles(df, [column], [i / bins for i in range(bins + 1)], names)
    edges = marks.select(F.array_distinct(F.array(*names))).scalar()
    x = F.col("_x")
    below = F.size(F.filter("_edges", lambda e: e < x))
    held = df.withColumn("_edges", edges).withColumn("_x", F.col(quoted(column)).cast("double"))
    number = F.when(x.isNotNull(), F.greatest(below - 1, F.lit(0)).cast("bigint"))
    return held.withColumn(output, number).drop("_edges", "_x")
