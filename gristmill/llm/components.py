"""Connected components of a graph of number-named nodes, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.storage import written


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def _signature(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that an edge joins to a smaller one; root is
    the smallest node of the component, which itself has no row.

    Each round points all neighbours of a node to its smallest neighbour, first
    the larger ones, then the smaller ones, until nothing changes: a number of
    rounds that grows with the logarithm of the longest path. A node's smallest
    neighbour comes from a grouped minimum, so a node with very many neighbours
    is combined before the shuffle. Only a count and a checksum reach the driver.
    Loops, null ends and repeated edges are ignored; no edges give no rows.
    """
    edges = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    edges = written(edges, "edges")
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_least(both), "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("least", "u").alias("v"))
            .distinct()
        )
        small = (
            large.join(_least(large), "u")
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("u"), F.col("least").alias("v")),
                        F.struct(F.col("v").alias("u"), F.col("least").alias("v")),
                    )
                ).alias("e")
            )
            .select("e.u", "e.v")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        edges = written(small, "edges")
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
