"""Value counts: the shared intermediate of every profile.

One grouped aggregation yields a row per distinct value. Repeats collapse on
the map side, so a value that fills a third of the table travels as one row
per map task, and the shuffle spreads by value rather than by feature.
Distinct counts, top values, modes and exact quantiles all follow from this
table without another look at the source.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.roles import quoted

#: A scan is cut into at most this many column slices of at least this many
#: columns. Unpivoting multiplies rows by the slice's width before the map-side
#: aggregation, so narrow slices keep that table small; each reads only its own
#: columns. The number of slices is bounded because each has tasks of its own.
MAX_SLICES = 8
MIN_SLICE = 4


def _slices(columns: Sequence, size: int | None) -> Iterable[list]:
    size = size or max(MIN_SLICE, -(-len(columns) // MAX_SLICES))
    for start in range(0, len(columns), size):
        yield list(columns[start : start + size])


def name_of(columns: Sequence[str], fid: Column) -> Column:
    """The column name behind a feature number."""
    return F.element_at(F.array(*[F.lit(c) for c in columns]), fid + 1)


def _tall(df: DataFrame, numbered: Sequence[tuple[int, str]], by: Sequence[str], cells) -> DataFrame:
    """Unpivot with a number, not a name, per feature: it is a grouping key."""
    rows = [", ".join([str(number), *cells(quoted(name))]) for number, name in numbered]
    width = len(cells("x"))
    keys = [f"cast({quoted(k)} as string) as k{i}" for i, k in enumerate(by)]
    names = ", ".join(["fid", *[f"v{i}" for i in range(width)]])
    return df.selectExpr(*keys, f"stack({len(rows)}, {', '.join(rows)}) as ({names})")


def text_counts(df: DataFrame, columns: Sequence[str], columns_per_scan: int | None = None) -> DataFrame:
    """Rows ``(feature, value, n)`` with values as strings; null is a row of its own."""
    parts = []
    for part in _slices(list(enumerate(columns)), columns_per_scan):
        tall = _tall(df, part, (), lambda c: [f"cast({c} as string)"])
        parts.append(tall.groupBy("fid", "v0").agg(F.count(F.lit(1)).alias("n")))
    name = F.coalesce(name_of(columns, F.col("fid")), F.lit(""))
    return reduce(DataFrame.union, parts).select(name.alias("feature"), F.col("v0").alias("value"), "n")


def _slot_type(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return kind.simpleString()
    return "double" if isinstance(kind, (T.FloatType, T.DoubleType)) else "bigint"


def number_counts(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), columns_per_scan: int | None = None
) -> DataFrame:
    """Rows ``(*k0.., fid, missing, x, n)`` for numeric columns.

    Values are told apart in their own type (64-bit whole numbers, doubles and
    each decimal type have a slot of their own), because beyond 2**53 a double
    would merge distinct ids; ``x`` is the value as a double. ``k0..`` are the
    ``by`` columns as strings.
    """
    types = {f.name: _slot_type(f.dataType) for f in df.schema}
    keys = [f"k{i}" for i in range(len(by))]
    parts = []
    # columns of one type lie together, so most slices need a single slot
    for part in _slices(sorted(enumerate(columns), key=lambda item: types[item[1]]), columns_per_scan):
        slots = sorted({types[name] for _, name in part})

        def cells(name: str, slots=slots) -> list[str]:
            own = types.get(name[1:-1].replace("``", "`"))
            return [f"cast({name if s == own else 'null'} as {s})" for s in slots]

        values = [f"v{i}" for i in range(len(slots))]
        x = f"coalesce({', '.join(f'cast({v} as double)' for v in values)})"
        counted = _tall(df, part, by, cells).groupBy(*keys, "fid", *values).agg(F.count(F.lit(1)).alias("n"))
        # `fid` and `x` are made non-null: no null check on them can slip below the aggregation
        parts.append(
            counted.selectExpr(
                *keys, "coalesce(fid, -1) as fid", f"{x} is null as missing", f"coalesce({x}, 0D) as x", "n"
            )
        )
    return reduce(DataFrame.union, parts)
