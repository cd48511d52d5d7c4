"""Label-encoding maps and the use of profile-derived maps on a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.roles import quoted
from gristmill.operators.cross import pair_name
from gristmill.operators.impute import one_row
from gristmill.operators.lookup import settled
from gristmill.operators.spread import running_sums

# Fixed value: the label of everything that has no id of its own.
OTHER = "OTH"


def encoding_map(summary: DataFrame, top: DataFrame) -> DataFrame:
    """``(feature, value, id)``: ids 1.. in rank order and ``OTH`` = 0 per feature.

    A real value ``OTH`` gives way to the marker and leaves its number unused.
    """
    own = top.where(F.col("value") != OTHER).select("feature", "value", F.col("rank").cast("bigint").alias("id"))
    other = summary.select("feature", F.lit(OTHER).alias("value"), F.lit(0).cast("bigint").alias("id"))
    return own.unionByName(other)


def child_map(parent: DataFrame, cross: DataFrame, pair: Sequence[str]) -> DataFrame:
    """Encoding of the second column of ``pair`` within the first.

    Distinct b-values are numbered from 0 as first seen (a-values by their
    largest count, ties by value; then b by rank), followed by one ``a-OTH`` per
    a-value and a final ``OTH``. a-values the parent's map does not know are
    skipped. Places and numbers are running counts over ranges, so neither many
    a-values nor many b-values meet in one task.
    """
    one = {"one": F.lit(1).cast("bigint")}
    known = cross.where(F.col("pair") == pair_name(*pair)).join(parent.select(F.col("value").alias("a")), "a", "left_semi")
    known = settled(known.select("a", "b", "rank", "count"))
    leading = known.groupBy("a").agg(F.max("count").alias("top"))
    order = running_sums(leading, [], [F.desc("top"), F.col("a")], one).select("a", F.col("one_before").alias("place"))
    seen = known.join(order, "a").groupBy("b").agg(F.min(F.struct("place", "rank")).alias("seen")).select("b", "seen.*")
    numbered = running_sums(seen, [], [F.col("place"), F.col("rank")], one)
    numbered = numbered.select(F.col("b").alias("value"), F.col("one_before").alias("id"))
    children, parents = (t.agg(F.count(F.lit(1))).scalar() for t in (numbered, order))
    others = order.select(F.concat("a", F.lit(f"-{OTHER}")).alias("value"), (children + F.col("place")).alias("id"))
    # an empty pair still has its OTH, numbered 0
    last = known.sparkSession.range(1).select(F.lit(OTHER).alias("value"), (children + parents).alias("id"))
    everything = numbered.unionByName(others).unionByName(last)
    # a label given twice keeps its later, larger number
    return everything.groupBy("value").agg(F.max("id").alias("id")).select(F.lit(pair[1]).alias("feature"), "value", "id")


def encoding_maps(
    summary: DataFrame, top: DataFrame, features: Sequence[str], cross: DataFrame | None, pairs: Sequence[Sequence[str]]
) -> dict[str, DataFrame]:
    """Map per feature; each pair, in order, replaces its second column's map."""
    plain = encoding_map(summary, top)
    maps = {f: plain.where(F.col("feature") == f) for f in features}
    for pair in pairs:
        parent, child = pair
        if parent not in maps:
            raise ValueError(f"{pair_name(parent, child)}: {parent} has no categorical profile")
        maps[child] = child_map(maps[parent], cross, pair)
    return maps


def encode_apply(df: DataFrame, encoding: DataFrame, column: str, output: str) -> DataFrame:
    """Ids from a feature's map, unknown and missing values to ``OTH``.

    A map may hold any number of values, so it is written out first and Spark picks
    the join from its size.
    """
    encoding = settled(encoding.where(F.col("feature") == column))
    other = encoding.where((F.col("feature") == column) & (F.col("value") == OTHER)).select("id").scalar()
    known = encoding.where((F.col("feature") == column) & (F.col("value") != OTHER)).select(
        F.col("value").alias("_value"), F.col("id").alias("_id")
    )
    joined = df.join(known, F.col(quoted(column)).cast("string") == F.col("_value"), "left")
    return joined.withColumn(output, F.coalesce("_id", other)).drop("_value", "_id")


def standardize_apply(df: DataFrame, params: DataFrame, columns: Sequence[str], suffix: str = "_std") -> DataFrame:
    """``(x - mean) / std`` with the parameters of a profile."""
    wanted = [(c, part) for c in columns for part in ("mean", "std")]
    held = df.withColumn("_fit", one_row(params, wanted))
    scaled = [
        F.try_divide(
            F.col(quoted(c)).cast("double") - F.col("_fit")[f"c{2 * i}"], F.col("_fit")[f"c{2 * i + 1}"]
        ).alias(c + suffix)
        for i, c in enumerate(columns)
    ]
    return held.select(*[quoted(c) for c in df.columns], *scaled)


def fillna_apply(df: DataFrame, fills: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill ``columns`` from a fill map (values kept as text, cast to the column)."""
    held = df.withColumn("_fill", one_row(fills, [(c, "fill_value") for c in columns]))
    cells = []
    for name in df.columns:
        c = F.col(quoted(name))
        if name in columns:
            # a median of a whole-number column may have a fraction
            kind = "string" if df.schema[name].dataType.typeName() == "string" else "double"
            c = F.coalesce(c.cast(kind), F.col("_fill")[f"c{list(columns).index(name)}"].cast(kind))
        cells.append(c.alias(name))
    return held.select(*cells)
