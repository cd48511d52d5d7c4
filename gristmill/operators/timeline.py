"""Past-only features of a time-ordered group: lag and rolling mean.

A plain window over ``partition by group`` puts a whole group in one task. Here every
row first gets its place in its group (``spread.running_sums``); places are cut into
segments of equal length, so bursts and ties in time make no segment larger. A row near
a segment's end is also handed to the next segment: a feature that looks back ``k`` rows
needs at most the last ``k`` before its segment. All groups take this one way, and the
result is that of the uncut window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.roles import quoted
from gristmill.functions.scalars import clock_micros
from gristmill.operators.spread import running_sums

ROWS_PER_SEGMENT = 100_000


def past_features(
    df: DataFrame,
    group: str,
    order: str,
    tie: str,
    value: str,
    lags: Sequence[int] = (),
    windows: Sequence[int] = (),
    rows_per_segment: int = ROWS_PER_SEGMENT,
) -> DataFrame:
    """``df`` with ``<value>_lag<k>`` and ``<value>_roll<k>`` columns.

    ``order`` is a timestamp, ``tie`` makes the order total. Lags repeat the
    earlier row's value, null or not; a rolling mean takes the present values
    of the ``k`` rows before the current one (null when there are none). Rows
    without a group get nulls and take no part.
    """
    reach = max([*lags, *windows])
    length = max(rows_per_segment, reach)
    columns = [quoted(c) for c in df.columns]
    names = [*[f"{value}_lag{k}" for k in lags], *[f"{value}_roll{k}" for k in windows]]
    g, v = F.col(quoted(group)), F.col(quoted(value))
    moment = clock_micros(F.col(quoted(order)), df.schema[order].dataType)

    grouped = df.where(g.isNotNull()).select(*columns, moment.alias("_t"))
    placed = running_sums(grouped, [group], [F.col("_t"), F.col(quoted(tie))], {"_at": F.lit(1).cast("bigint")})
    segment, into = F.floor(F.col("_at_before") / length), F.col("_at_before") % length
    # the last rows of a segment also stand before the next one
    later = (into >= length - reach) & (F.col("_at_before") + (length - into) < F.col("_at_total"))
    shares = F.array(F.struct(segment.alias("seg"), F.lit(True).alias("own")))
    both = F.array(
        F.struct(segment.alias("seg"), F.lit(True).alias("own")), F.struct((segment + 1).alias("seg"), F.lit(False).alias("own"))
    )
    dealt = placed.select(*columns, "_at_before", F.explode(F.when(later, both).otherwise(shares)).alias("_s"))
    w = Window.partitionBy(g, F.col("_s.seg")).orderBy("_at_before")
    features: list[Column] = [F.lag(v, k).over(w).alias(f"{value}_lag{k}") for k in lags]
    features += [F.avg(v.cast("double")).over(w.rowsBetween(-k, -1)).alias(f"{value}_roll{k}") for k in windows]
    made = dealt.select(*columns, "_s", *features).where("_s.own").drop("_s")
    kinds = {f.name: f.dataType for f in made.schema}
    lost = df.where(g.isNull()).select(*columns, *[F.lit(None).cast(kinds[n]).alias(n) for n in names])
    return made.unionByName(lost)
