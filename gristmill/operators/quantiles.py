"""Exact quantiles of any size, by narrowing rather than by sorting.

A single-group ``percentile`` keeps every distinct value of the group in one
task. Here the answer is located in narrowing steps over value counts:

1. a coarse bucket, a monotone function of the value (1,024 buckets per power
   of two), is counted per key; running totals say which buckets hold the
   wanted ranks;
2. the values of those buckets alone, about a thousandth of the value counts,
   are shuffled by 65,536 equal steps between their bucket's least and greatest
   value, and counted per step;
3. only the steps that hold a wanted rank are ordered by value.

No task ever holds more than the bucket table of one key or the distinct values
of one tiny step. The value counts are read twice, once per bucket table and
once for the chosen buckets; moments over a range come from bucket sums plus
the values of the two buckets at its ends.

Readers of one shuffle ask for the same columns and put no filter below it, so
that Spark runs it once and serves the others from it. Where a reader has no use
for a column, an always-true condition names it; ``tests/test_plans.py`` holds
the plan to one scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS_PER_OCTAVE = 1024
FINE_STEPS = 65536
# log2 of a double lies in [-1074, 1024]; infinity and NaN are held at 1100.
_LOG_CEILING = 1100
_SHIFT = 1_200_000
_TOP = _LOG_CEILING * STEPS_PER_OCTAVE + _SHIFT
_MISSING = -(2**40)


def bucket_of(x: str) -> str:
    """Whole number that never decreases as ``x`` grows."""
    size = f"floor(least(log2(abs({x})), {_LOG_CEILING}D) * {STEPS_PER_OCTAVE}) + {_SHIFT}"
    return f"case when {x} = 0 then 0 when {x} > 0 then {size} else -({size}) end"


# A value inside (or at the edge of) a bucket, from the bucket alone.
_CENTRE = f"""case when bucket = 0 or abs(bucket) >= {_TOP} then 0D
    else signum(bucket) * pow(2D, (abs(bucket) - {_SHIFT}) / {STEPS_PER_OCTAVE}D) end"""

_STEP = f"""coalesce(case when abs(bucket) <> {_TOP} and high > low
    then floor((x - low) / (high - low) * {FINE_STEPS}) end, 0L)"""


def inside(ranks: str, end: str, rows: str) -> str:
    """Those of ``ranks`` that lie in the ``rows`` places before ``end``."""
    return f"filter({ranks}, r -> r >= {end} - {rows} and r < {end})"


def wanted_ranks(probabilities: Sequence[float]) -> str:
    """The places (from 0) that quantiles of ``valid`` values lie at or between."""
    ranks = [f"cast({side}({float(p)!r}D * (valid - 1)) as bigint)" for p in probabilities for side in ("floor", "ceil")]
    return f"array_distinct(array({', '.join(ranks)}))"


@dataclass(frozen=True)
class Located:
    """``summary`` has one row per key with its counts and extremes; ``picked``
    maps the wanted ranks of each key that has values to those values;
    ``buckets`` and ``near`` are the bucket table and the values of the chosen
    buckets."""

    keys: list[str]
    few_keys: bool
    buckets: DataFrame
    near: DataFrame
    picked: DataFrame
    summary: DataFrame

    def quantiles(self, probabilities: Sequence[float], names: Sequence[str]) -> DataFrame:
        """``(*keys, <names>)``, linear interpolation; keys without values are absent."""
        columns = []
        for probability, name in zip(probabilities, names, strict=True):
            place = f"({float(probability)!r}D * (valid - 1))"
            low, high = (f"at[cast({side}({place}) as bigint)]" for side in ("floor", "ceil"))
            columns.append(
                f"case when {low} = {high} then {low} else {low} + ({high} - {low}) * ({place} - floor({place})) end as `{name}`"
            )
        return self.picked.selectExpr(*self.keys, *columns)

    def with_summary(self, *tables: DataFrame) -> DataFrame:
        """Every key of ``summary``, with the columns of ``tables`` or nulls."""
        result = self.summary
        for table in tables:
            result = result.join(F.broadcast(table) if self.few_keys else table, self.keys, "left")
        return result

    def moments(self, bounds: DataFrame | None = None) -> DataFrame:
        """``(*keys, mean, std)`` of the values between ``bounds``, ends included
        (of all values without bounds); needs ``locate(..., moments=True)``.

        ``bounds`` has ``(*keys, first, centre, last)``, one row per key of a
        few-keys profile, so it is broadcast. Whole buckets contribute their
        sums, moved to ``centre``; the two end buckets contribute value by value.
        """
        bounded = bounds is not None
        whole = f"bucket <> {_MISSING}"
        if bounded:
            whole += f" and bucket > {bucket_of('first')} and bucket < {bucket_of('last')}"
        else:
            bounds = self.picked.selectExpr(*self.keys, "element_at(map_values(at), 1) as centre")
        shift = f"({_CENTRE} - centre)"
        # conditions sit inside the sums: as a filter they would reach below the bucket shuffle
        kept = f"({whole}) and distinct > 0 and (low is null or low <= high)"
        full = self.buckets.join(F.broadcast(bounds), self.keys).selectExpr(
            *self.keys,
            "centre",
            f"case when {kept} then rows end as k",
            f"case when {kept} then s1 + rows * {shift} end as s1",
            f"case when {kept} then s2 + 2 * {shift} * s1 + rows * {shift} * {shift} end as s2",
        )
        parts = [full]
        if bounded:
            at_edge = f"""bucket in ({bucket_of('first')}, {bucket_of('last')}) and x between first and last
                and step >= 0 and before >= 0 and valid > 0 and size(ranks) > 0"""
            terms = {"k": "n", "s1": "n * (x - centre)", "s2": "n * (x - centre) * (x - centre)"}
            ends = self.near.join(F.broadcast(bounds), self.keys).groupBy(*self.keys)
            sums = [F.expr(f"sum(case when {at_edge} then {term} end)").alias(name) for name, term in terms.items()]
            parts.append(ends.agg(F.first("centre").alias("centre"), *sums))
        total = (
            reduce(DataFrame.unionByName, parts)
            .groupBy(*self.keys)
            .agg(F.first("centre").alias("centre"), *[F.sum(c).alias(c) for c in ("k", "s1", "s2")])
        )
        return total.selectExpr(
            *self.keys,
            "centre + s1 / k as mean",
            "case when k > 1 then sqrt(greatest(s2 - s1 * s1 / k, 0D) / (k - 1)) end as std",
        )


def locate(
    counts: DataFrame, keys: Sequence[str], probabilities: Sequence[float], few_keys: bool, moments: bool = False
) -> Located:
    """Find the values at the ranks that ``probabilities`` need.

    ``counts`` holds ``(*keys, missing, x, n)``. ``few_keys`` states that the
    number of keys is bounded by the schema (one per column), which bounds the
    chosen buckets and lets them be broadcast; otherwise Spark picks the join
    from the sizes it measures.
    """
    keys = list(keys)
    names = ", ".join(keys)
    small = F.broadcast if few_keys else (lambda d: d)
    bucketed = counts.selectExpr(
        *keys, "missing", "x", "n", f"coalesce(case when missing then {_MISSING}L else {bucket_of('x')} end, {_MISSING}L) as bucket"
    )
    real = "case when not missing and not isnan(x) then x end"
    sums = [f"sum(n * (x - {_CENTRE})) as s1", f"sum(n * (x - {_CENTRE}) * (x - {_CENTRE})) as s2"] if moments else []
    measures = ["sum(n) as rows", "count(1) as distinct", f"min({real}) as low", f"max({real}) as high", *sums]
    buckets = bucketed.groupBy(*keys, "bucket").agg(*[F.expr(m) for m in measures])
    used = "rows >= distinct" + (" and (rows > 0 or s1 + s2 is null)" if moments else "")

    weight = f"case when bucket <> {_MISSING} then rows else 0L end"
    hits = (
        buckets.selectExpr(
            "*",
            f"{weight} as weight",
            f"sum({weight}) over (partition by {names} order by bucket rows unbounded preceding) as end",
            f"sum({weight}) over (partition by {names}) as valid",
        )
        .selectExpr("*", f"{inside(wanted_ranks(probabilities), 'end', 'weight')} as ranks")
        .where(f"size(ranks) > 0 and {used}")
        .selectExpr(*keys, "bucket", "end - weight as before", "valid", "ranks", "low", "high")
    )
    near = (
        bucketed.join(small(hits), [*keys, "bucket"])
        .selectExpr(*keys, "bucket", f"{_STEP} as step", "x", "n", "before", "valid", "ranks")
        .repartition(*keys, "bucket", "step")
    )
    steps = (
        near.groupBy(*keys, "bucket", "step")
        .agg(
            F.sum("n").alias("weight"),
            *[F.first(c).alias(c) for c in ("before", "valid", "ranks")],
            F.min("x").alias("low"),
            F.max("x").alias("high"),
        )
        .selectExpr(
            "*",
            f"sum(weight) over (partition by {names}, bucket order by step rows unbounded preceding) - weight as offset",
        )
        .where(f"low <= high and valid > 0 and size({inside('ranks', '(before + offset + weight)', 'weight')}) > 0")
        .select(*keys, "bucket", "step", "offset")
    )
    picked = (
        near.join(small(steps), [*keys, "bucket", "step"])
        .selectExpr(
            *keys, "valid", "x", "n", "ranks",
            f"before + offset + sum(n) over (partition by {names}, bucket, step order by x rows unbounded preceding) as end",
        )
        .selectExpr(*keys, "valid", "x", f"explode({inside('ranks', 'end', 'n')}) as rank")
        .groupBy(*keys)
        .agg(F.first("valid").alias("valid"), F.expr("map_from_entries(collect_list(struct(rank, x)))").alias("at"))
    )
    summary = (
        buckets.groupBy(*keys)
        .agg(
            *[
                F.expr(e)
                for e in (
                    "sum(rows) as total_rows",
                    f"coalesce(sum(case when bucket = {_MISSING} then rows end), 0L) as null_count",
                    "sum(distinct) as nunique",
                    "min(low) as min",
                    "max(high) as max",
                    "coalesce(sum(case when bucket = 0 then rows end), 0L) as zero_count",
                    *(["sum(case when rows > 0 then 0D else s1 + s2 end) as spare"] if moments else []),
                )
            ]
        )
        .where("total_rows >= nunique and (min is null or min <= max)" + (" and spare = 0" if moments else ""))
    )
    return Located(keys, few_keys, buckets, near, picked, summary)
