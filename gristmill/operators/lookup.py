"""Joining a table of rows with a derived table of one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gristmill.session import scratch_path


def settled(table: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read back.

    A derived table's size is only guessed at planning time, and the guess grows
    with the rows it came from. Written out, its size is known before the join
    is planned: below Spark's broadcast threshold it is broadcast and the rows
    stay where they are; above it both sides are shuffled and adaptive execution
    splits the partition of a hot key. It is also computed only once.
    """
    path = scratch_path(table.sparkSession, "lookup")
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def left_lookup(df: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """``df`` with the columns of ``table``, which has one row per key; keys it
    does not know, and missing keys, give nulls."""
    return df.join(settled(table), list(on), "left")
