"""Running sums along an order, without a task that holds a whole group.

A window over ``partition by group`` gathers a group in one task. Here the rows are
dealt by ranges of (group, order), so a large group lies in several neighbouring
partitions of about equal size. Sums run within a partition; what the earlier
partitions of a group hold is carried over. At most two groups of a partition reach
beyond it, so the table of carried sums has at most two rows per partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.roles import quoted
from gristmill.operators.lookup import settled

_PART, _GROUP = "_part", "_group"


def running_sums(df: DataFrame, within: Sequence[str], order: Sequence[Column], amounts: Mapping[str, Column]) -> DataFrame:
    """``df`` with ``<name>_before`` (sum over the group's earlier rows) and
    ``<name>_total`` (sum over the group) for each of ``amounts``.

    ``order`` must tell the rows of a group apart; null groups are groups. The ranges
    come from a sample that Spark takes, the rows are written once, and ties of the
    whole order stay in one partition.
    """
    columns = [F.col(quoted(c)) for c in df.columns]
    group = F.struct(*[F.col(quoted(c)).alias(f"g{k}") for k, c in enumerate(within)]) if within else F.struct(F.lit(0).alias("g0"))
    held = df.select(*columns, group.alias(_GROUP), *[a.alias(f"{n}_amount") for n, a in amounts.items()])
    dealt = held.repartitionByRange(F.col(_GROUP), *order).withColumn(_PART, F.spark_partition_id())
    placed = settled(dealt)

    # groups that several partitions hold are the first or last of each of them
    ends = placed.groupBy(_PART).agg(F.min(_GROUP).alias("low"), F.max(_GROUP).alias("high"))
    reaching = (
        ends.select(_PART, F.explode(F.array("low", "high")).alias(_GROUP))
        .groupBy(_GROUP)
        .agg(F.count_distinct(_PART).alias("parts"))
        .where("parts > 1")
        .select(F.col(_GROUP).alias("_reaching"))
    )
    pieces = (
        placed.join(F.broadcast(reaching), F.col(_GROUP).eqNullSafe(F.col("_reaching")), "left_semi")
        .groupBy(_GROUP, _PART)
        .agg(*[F.sum(f"{n}_amount").alias(f"{n}_piece") for n in amounts])
    )
    along = Window.partitionBy(_GROUP).orderBy(_PART)
    carried = pieces.select(
        F.col(_PART).alias("_at"),
        F.col(_GROUP).alias("_of"),
        *[F.coalesce(F.sum(f"{n}_piece").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{n}_carried") for n in amounts],
        *[F.sum(f"{n}_piece").over(Window.partitionBy(_GROUP)).alias(f"{n}_whole") for n in amounts],
    )
    here = Window.partitionBy(_PART, _GROUP)
    earlier = here.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.select(
        "*",
        *[F.coalesce(F.sum(f"{n}_amount").over(earlier), F.lit(0)).alias(f"{n}_here") for n in amounts],
        *[F.sum(f"{n}_amount").over(here).alias(f"{n}_part") for n in amounts],
    )
    met = (F.col(_PART) == F.col("_at")) & F.col(_GROUP).eqNullSafe(F.col("_of"))
    joined = summed.join(F.broadcast(carried), met, "left")
    return joined.select(
        *columns,
        *[(F.col(f"{n}_here") + F.coalesce(f"{n}_carried", F.lit(0))).alias(f"{n}_before") for n in amounts],
        *[F.coalesce(f"{n}_whole", f"{n}_part").alias(f"{n}_total") for n in amounts],
    )
