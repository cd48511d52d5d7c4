"""Distribution of one categorical column within another."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.roles import quoted
from gristmill.operators.spread import running_sums

# The separator of a pair name and the share of an a-value's rows to cover.
PAIR_SEPARATOR = "__x__"
COVERAGE = 0.95


def pair_name(a: str, b: str) -> str:
    return f"{a}{PAIR_SEPARATOR}{b}"


def known_pairs(df: DataFrame, pairs: Sequence[Sequence[str]]) -> list[tuple[str, str]]:
    """Well-formed pairs of existing columns; others are left out."""
    return [(p[0], p[1]) for p in pairs if len(p) == 2 and p[0] in df.columns and p[1] in df.columns]


def pair_counts(df: DataFrame, pairs: Sequence[Sequence[str]]) -> DataFrame:
    """``(pair, a, b, n)`` for rows where both sides are present."""
    pairs = known_pairs(df, pairs)
    if not pairs:
        raise ValueError("no pair of existing columns")
    cells = []
    for number, (a, b) in enumerate(pairs):
        cells += [F.lit(number), F.col(quoted(a)).cast("string"), F.col(quoted(b)).cast("string")]
    names = F.array(*[F.lit(pair_name(a, b)) for a, b in pairs])
    return (
        df.select(F.stack(F.lit(len(pairs)), *cells).alias("pid", "a", "b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("pid", "a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.coalesce(F.element_at(names, F.col("pid") + 1), F.lit("")).alias("pair"), "a", "b", "n")
    )


def combinations(counts: DataFrame) -> DataFrame:
    """Distinct value pairs per column pair. Values stay separate columns, so a
    value that holds a separator cannot merge two pairs."""
    return counts.groupBy("pair").agg(F.count(F.lit(1)).alias("combinations"))


def within_limit(counts: DataFrame, max_combinations: int) -> DataFrame:
    """Counts of the pairs of at most ``max_combinations`` value pairs; the rest yield
    nothing. For callers that want such a limit: no other function sets one.

    The list of pairs comes from the caller, so the broadcast side has one row
    per pair named.
    """
    allowed = combinations(counts).where(F.col("combinations") <= max_combinations).select("pair")
    return counts.join(F.broadcast(allowed), "pair")


def with_totals(counts: DataFrame) -> DataFrame:
    """Adds the row total of each a-value."""
    totals = counts.groupBy("pair", "a").agg(F.sum("n").alias("a_rows"))
    return counts.join(totals, ["pair", "a"])


def cross_coverage(counts: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``(pair, a, b, rank, count, ratio)``: per a-value the most frequent
    b-values until ``coverage`` of that a-value's rows, crossing one included.

    The counts are dealt by ranges of pair, a-value and rank, so an a-value with any
    number of b-values is spread over tasks. Ties go to the smaller b-value.
    """
    numerator, denominator = Decimal(str(coverage)).as_integer_ratio()
    amounts = {"rows": F.col("n"), "one": F.lit(1).cast("bigint")}
    summed = running_sums(counts, ["pair", "a"], [F.desc("n"), F.col("b")], amounts)
    short = F.col("rows_before") * F.lit(denominator) < F.col("rows_total") * F.lit(numerator)
    return summed.where(short).select(
        "pair",
        "a",
        "b",
        (F.col("one_before") + 1).alias("rank"),
        F.col("n").alias("count"),
        (F.col("n") / F.col("rows_total")).alias("ratio"),
    )
