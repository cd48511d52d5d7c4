"""Small helpers for column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, wherever lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rows(spark: SparkSession, records: list[dict], schema: str) -> DataFrame:
    """A table of a few rows that the caller bounds, made by the JVM alone."""
    text = F.lit(json.dumps(records))
    return spark.range(1).select(F.inline(F.from_json(text, f"array<struct<{schema}>>")))
