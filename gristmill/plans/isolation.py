"""Profiles in which a column that fails does not take the others with it."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from gristmill.operators.lookup import settled

ERRORS = "feature string, problem string"

log = logging.getLogger(__name__)


def isolated(
    columns: Sequence[str], build: Callable[[list[str]], tuple[DataFrame, ...]]
) -> tuple[list[tuple[DataFrame, ...]], list[tuple[str, str]]]:
    """``(tables, failures)``: the written tables of ``build`` over those columns that
    can be read, and ``(column, problem)`` of the others.

    All columns run as one plan; only when that fails are they halved, and the halves
    that fail again, so one bad column among n costs about 2 log2(n) more plans, each
    over its own columns. When every column fails the fault is not a column's, and the
    first error is raised.
    """
    done: list[tuple[DataFrame, ...]] = []
    failures: list[tuple[str, str]] = []
    first: Exception | None = None
    waiting = [list(columns)] if columns else []
    while waiting:
        part = waiting.pop()
        try:
            done.append(tuple(settled(t) for t in build(part)))
        except (PySparkException, Py4JJavaError) as error:
            first = first or error
            if len(part) > 1:
                half = len(part) // 2
                waiting += [part[half:], part[:half]]
                continue
            problem = _problem(error)
            log.error("column %r is left out: %s", part[0], problem)
            failures.append((part[0], problem))
    if first is not None and not done:
        raise first
    return done, failures


def _problem(error: Exception) -> str:
    """The condition that Spark names, such as DIVIDE_BY_ZERO, else the message's first line."""
    text = str(error)
    for name in ("DIVIDE_BY_ZERO", "CAST_INVALID_INPUT", "ARITHMETIC_OVERFLOW", "NUMERIC_VALUE_OUT_OF_RANGE"):
        if f"[{name}" in text:
            return name
    condition = error.getCondition() if isinstance(error, PySparkException) else None
    return condition or text.strip().split("\n")[0]


def error_table(spark: SparkSession, failures: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(failures), ERRORS)
