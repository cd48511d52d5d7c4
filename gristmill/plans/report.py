"""Config maps and report tables, from profile tables only.

Nothing here reads the source again: every input has a row per feature, per
kept value or per kept value pair. A report shows the first features and values;
how many is a parameter, and None shows all.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import scalars
from gristmill.operators.numeric import PROFILE_COLUMNS

# Features shown per report table and values shown per cell, unless asked otherwise.
REPORT_FEATURES = 10
REPORT_VALUES = 3
PREVIEW_VALUES = 10


def drop_list(num: DataFrame) -> DataFrame:
    reason = scalars.drop_reason(F.col("null_ratio"), F.col("nunique"), F.col("zero_ratio"))
    return num.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("feature", "reason")


def embedding_dims(cat: DataFrame) -> DataFrame:
    return cat.select("feature", "nunique", scalars.embedding_dim(F.col("nunique")).alias("embedding_dim"))


def fill_strategies(cat: DataFrame) -> DataFrame:
    return cat.select("feature", scalars.fill_strategy(F.col("null_ratio")).alias("strategy"))


def analyze(num: DataFrame, cat: DataFrame, top: DataFrame | None = None, values: int = PREVIEW_VALUES) -> DataFrame:
    """One row per feature with what applies to its kind: the figures and the
    recommendations, and the ``values`` most frequent values with their shares where
    ``top`` is given."""
    leading = None
    if top is not None:
        entries = F.array_sort(F.array_agg(F.struct("rank", "value", "ratio")))
        leading = top.where(F.col("rank") <= values).groupBy("feature").agg(
            F.transform(entries, lambda e: e["value"]).alias("top_categories"),
            F.transform(entries, lambda e: e["ratio"]).alias("top_ratios"),
        )
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    reason = scalars.drop_reason(F.col("null_ratio"), F.col("nunique"), F.col("zero_ratio"))
    numeric = num.select(
        "feature",
        F.lit("numeric").alias("kind"),
        "nunique",
        "null_ratio",
        "zero_ratio",
        *[F.col(c) for c in ("mean", "std", "min", "max")],
        reason.alias("drop_reason"),
        none("bigint", "embedding_dim"),
        none("string", "fill_strategy"),
        *([none("array<string>", "top_categories"), none("array<double>", "top_ratios")] if leading is not None else []),
    )
    # one row per column on either side
    shown = cat.join(F.broadcast(leading), "feature", "left") if leading is not None else cat
    categorical = shown.select(
        "feature",
        F.lit("categorical").alias("kind"),
        "nunique",
        "null_ratio",
        *[none("double", c) for c in ("zero_ratio", "mean", "std", "min", "max")],
        none("string", "drop_reason"),
        scalars.embedding_dim(F.col("nunique")).alias("embedding_dim"),
        scalars.fill_strategy(F.col("null_ratio")).alias("fill_strategy"),
        *(["top_categories", "top_ratios"] if leading is not None else []),
    )
    return numeric.unionByName(categorical)


def fillna_map(num: DataFrame, cat: DataFrame, top: DataFrame) -> DataFrame:
    """``(feature, kind, fill_value)`` for features with gaps; values as text.

    Numbers take the median (0 when mean and deviation are both 0), categories
    their most frequent value or ``unknown``.
    """
    zeros = (F.col("mean") == 0) & (F.col("std") == 0)
    numbers = num.where(F.col("null_ratio") > 0).select(
        "feature",
        F.lit("number").alias("kind"),
        F.when(zeros, F.lit(0.0)).otherwise(F.col("median")).cast("string").alias("fill_value"),
    )
    leading = top.where(F.col("rank") == 1).select("feature", "value")
    texts = (
        cat.where(F.col("null_ratio") > 0)
        .join(F.broadcast(leading), "feature", "left")
        .select("feature", F.lit("text").alias("kind"), F.coalesce("value", F.lit("unknown")).alias("fill_value"))
    )
    return numbers.unionByName(texts)


def std_params(num: DataFrame) -> DataFrame:
    return num.select("feature", "mean", "std")


def _listed(entries: Column, limit: int, show) -> Column:
    """Texts of the first ``limit`` entries of an array of structs, by their first field."""
    return F.transform(F.slice(F.array_sort(entries), 1, limit), show)


def flatten_cat(cat: DataFrame, top: DataFrame, values: int = PREVIEW_VALUES) -> DataFrame:
    """One row per feature with its ``values`` most frequent values as text."""
    entry = F.struct("rank", "value", "count", "ratio")
    preview = _listed(
        F.array_agg(entry),
        values,
        lambda e: F.concat(
            e["value"], F.lit(": "), e["count"].cast("string"), F.lit(" ("), scalars.decimals(e["ratio"], 4), F.lit(")")
        ),
    )
    shown = top.where(F.col("rank") <= values).groupBy("feature").agg(
        F.array_join(preview, "; ").alias("top10_preview")
    )
    return cat.join(F.broadcast(shown), "feature", "left").select(
        "feature",
        "nunique",
        "null_count",
        "null_ratio",
        F.coalesce("top10_preview", F.lit("")).alias("top10_preview"),
        "skipped",
    )


def flatten_num(num: DataFrame) -> DataFrame:
    """One row per feature, the figures alone: whatever else a caller has joined to the
    profile, such as the medians of groups, stays out."""
    return num.select(*PROFILE_COLUMNS)


def flatten_cross(cross: DataFrame, values: int = REPORT_VALUES) -> DataFrame:
    """Per pair: a-values, kept items, and a preview of ``values`` a-values with as many
    items each. a-values come by their largest count, ties by value."""
    totals = cross.groupBy("pair", "a").agg(
        F.count(F.lit(1)).alias("items"),
        F.max("count").alias("top"),
        F.array_agg(
            F.when(F.col("rank") <= values, F.struct("rank", "b", "ratio"))
        ).alias("first"),
    )
    lead = Window.partitionBy("pair").orderBy(F.desc("top"), "a")
    texts = _listed(
        F.array_compact("first"), values, lambda e: F.concat(e["b"], F.lit("("), scalars.decimals(e["ratio"], 4), F.lit(")"))
    )
    shown = (
        totals.withColumn("place", F.row_number().over(lead))
        .where(F.col("place") <= values)
        .withColumn("text", F.concat("a", F.lit(": ["), F.array_join(texts, ", "), F.lit("]")))
        .groupBy("pair")
        .agg(F.array_sort(F.array_agg(F.struct("place", "text"))).alias("parts"))
        .select("pair", F.array_join(F.transform("parts", lambda e: e["text"]), "; ").alias("preview"))
    )
    sizes = totals.groupBy("pair").agg(F.count(F.lit(1)).alias("total_a"), F.sum("items").alias("total_items"))
    return sizes.join(shown, "pair").select("pair", "total_a", "total_items", "preview")


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in cells]), F.lit(" |"))


def _place(features: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")).cast("bigint")


def report_rows(
    num: DataFrame,
    cat: DataFrame,
    top: DataFrame,
    num_order: Sequence[str],
    cat_order: Sequence[str],
    features: int | None = REPORT_FEATURES,
    values: int = REPORT_VALUES,
) -> DataFrame:
    """``(section, position, line)``: the report's tables, one row per line.

    First the number of features of each kind. Then the first ``features`` of each kind
    in table order (all for None); the drop list names every feature it applies to.
    Missing numbers give empty cells.
    """
    last = max(len(num_order), len(cat_order), 1) if features is None else features
    parts = []
    for position, (kind, table, order) in enumerate((("numeric", num, num_order), ("categorical", cat, cat_order)), 1):
        if order:
            parts.append(
                table.agg(F.count(F.lit(1)).cast("string").alias("n")).select(
                    F.lit("features").alias("section"),
                    F.lit(position).cast("bigint").alias("position"),
                    F.concat(F.lit(f"- {kind}: "), "n").alias("line"),
                )
            )
    if num_order:
        place = _place(num_order)
        two = [scalars.decimals(F.col(c), 2) for c in ("mean", "std", "min", "max")]
        parts.append(
            drop_list(num).select(
                F.lit("drop").alias("section"),
                place.alias("position"),
                F.concat(F.lit("- **"), "feature", F.lit("**: "), "reason").alias("line"),
            )
        )
        parts.append(
            num.where(place <= last).select(
                F.lit("numeric").alias("section"),
                place.alias("position"),
                _row(
                    F.col("feature"),
                    scalars.percent(F.col("null_ratio"), 2),
                    scalars.percent(F.col("zero_ratio"), 2),
                    F.col("nunique").cast("string"),
                    *two,
                ).alias("line"),
            )
        )
    if cat_order:
        place = _place(cat_order)
        first = top.where(F.col("rank") <= values).groupBy("feature").agg(
            F.array_sort(F.array_agg(F.struct("rank", "value", "ratio"))).alias("first")
        )
        shown = cat.where(place <= last).join(F.broadcast(first), "feature", "left")
        values = F.array_join(F.transform("first", lambda e: e["value"]), ", ")
        shares = F.array_join(F.transform("first", lambda e: scalars.percent(e["ratio"], 1)), ", ")
        parts.append(
            shown.select(
                F.lit("categorical").alias("section"),
                place.alias("position"),
                _row(
                    F.col("feature"),
                    scalars.percent(F.col("null_ratio"), 2),
                    F.col("nunique").cast("string"),
                    values,
                    shares,
                ).alias("line"),
            )
        )
        parts.append(
            embedding_dims(cat).where(place <= last).select(
                F.lit("embedding").alias("section"),
                place.alias("position"),
                _row(F.col("feature"), F.col("nunique").cast("string"), F.col("embedding_dim").cast("string")).alias("line"),
            )
        )
    return reduce(DataFrame.unionByName, parts)
