"""Train-only imputation and the row mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.roles import imputation_roles, quoted
from gristmill.operators import numeric
from gristmill.operators.counts import text_counts


def align(train: DataFrame, test: DataFrame, target: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Columns both frames share, in train order; the target stays on train only.

    The target travels as a column of its rows, never by row position.
    """
    shared = [c for c in train.columns if c != target and c in test.columns]
    kept = [quoted(c) for c in shared]
    label = [quoted(target)] if target in train.columns else []
    return train.select(*kept, *label), test.select(*kept), shared


def fit(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, kind, number, text)``: median of each numeric column and the
    most frequent value of every other one (the smallest on a tie)."""
    roles = imputation_roles(train.select(*[quoted(c) for c in columns]))
    parts = []
    if roles.numeric:
        medians = numeric.quantiles(train, roles.numeric, [0.5], ["number"])
        parts.append(
            medians.select("feature", F.lit("median").alias("kind"), "number", F.lit(None).cast("string").alias("text"))
        )
    if roles.categorical:
        counts = text_counts(train, roles.categorical)
        candidate = F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("order"), "value"))
        modes = counts.groupBy("feature").agg(F.min(candidate).alias("best"))
        parts.append(
            modes.select(
                "feature",
                F.lit("most_frequent").alias("kind"),
                F.lit(None).cast("double").alias("number"),
                F.col("best.value").alias("text"),
            )
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def one_row(table: DataFrame, wanted: Sequence[tuple[str, str]]) -> Column:
    """Cells of a small per-feature table as one struct value ``c0, c1, ...``.

    ``wanted`` names ``(feature, column)`` cells. It is a scalar subquery:
    computed once, then a constant of the scan.
    """
    cells = [F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"c{i}") for i, (f, c) in enumerate(wanted)]
    return table.agg(*cells).select(F.struct(*[f"c{i}" for i in range(len(wanted))])).scalar()


def apply(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill ``columns`` with the fitted values; numeric ones become doubles.
    A column that was all null in train has no fill value and stays as it is."""
    roles = imputation_roles(df.select(*[quoted(c) for c in columns]))
    wanted = [(c, "number") for c in roles.numeric] + [(c, "text") for c in roles.categorical]
    place = {name: f"c{i}" for i, (name, _) in enumerate(wanted)}
    filled = []
    for name in df.columns:
        c = F.col(quoted(name))
        if name in place:
            own = "double" if name in roles.numeric else df.schema[name].dataType
            c = F.coalesce(c.cast(own), F.col("_fit")[place[name]].cast(own))
        filled.append(c.alias(name))
    return df.withColumn("_fit", one_row(fitted, wanted)).select(*filled)


def row_mean(df: DataFrame, columns: Sequence[str], output: str = "row_mean") -> DataFrame:
    """Mean over the present values of numeric ``columns`` in each row."""
    cells = [F.col(quoted(c)).cast("double") for c in columns]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cells), F.lit(0.0))
    present = sum((c.isNotNull().cast("int") for c in cells), F.lit(0))
    return df.withColumn(output, F.try_divide(total, present))
