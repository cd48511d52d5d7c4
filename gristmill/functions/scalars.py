"""Column expressions without state of their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Calendar parts and how to read them (weekday: Monday = 0).
CALENDAR = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "weekday": F.weekday,
    "week": F.weekofyear,
}


def datetime_parts(moment: Column, prefix: str) -> list[Column]:
    return [read(moment).alias(f"{prefix}_{part}") for part, read in CALENDAR.items()]


def clock_micros(moment: Column, kind: T.DataType) -> Column:
    """Microseconds that grow with time.

    A timestamp without zone is read off its calendar fields, so neither the
    session's zone nor its clock changes can reorder rows.
    """
    if isinstance(kind, T.TimestampNTZType):
        day = F.unix_date(moment.cast("date")).cast("bigint")
        minutes = (day * 24 + F.hour(moment)) * 60 + F.minute(moment)
        seconds = F.extract(F.lit("SECOND"), moment)
        return minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint")
    return F.unix_micros(moment.cast("timestamp"))


def embedding_dim(nunique: Column) -> Column:
    """Suggested embedding width for a number of distinct values."""
    n = nunique.cast("bigint")
    return (
        F.when(n <= 10, F.least(F.lit(4), n))
        .when(n <= 50, F.least(F.lit(8), n))
        .when(n <= 100, F.least(F.lit(16), n))
        .otherwise(F.least(F.lit(32), F.floor(F.sqrt(n))))
        .cast("bigint")
    )


def fill_strategy(null_ratio: Column) -> Column:
    return F.when(null_ratio > 0, F.lit("mode")).otherwise(F.lit("none"))


def drop_reason(null_ratio: Column, nunique: Column, zero_ratio: Column) -> Column:
    """Why a numeric column is not worth keeping; null when it is.

    Null counts as a distinct value, so a constant with gaps is kept.
    """
    return (
        F.when(null_ratio > 0.9, F.lit("missing"))
        .when(nunique == 1, F.lit("constant"))
        .when(zero_ratio > 0.95, F.lit("zeros"))
    )


def product(a: Column, b: Column) -> Column:
    return a * b


def joined_text(a: Column, b: Column) -> Column:
    """Two values as one category; null when either is."""
    return F.concat(a.cast("string"), F.lit("_"), b.cast("string"))


def decimals(value: Column, places: int) -> Column:
    """Fixed-point text of a number (half away from zero)."""
    return F.round(value, places).cast(f"decimal(38,{places})").cast("string")


def percent(ratio: Column, places: int) -> Column:
    return F.concat(decimals(ratio * 100, places), F.lit("%"))
