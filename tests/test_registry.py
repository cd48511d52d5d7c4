"""Every registered query against its SQL, on the smallest tables."""

import math
import re

import pytest

import registry
from conftest import SF

QUERIES, SQL = registry.all_queries(), registry.all_sql()


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def check_plan(df):
    """No Python workers, no cross join, no window without partition columns."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups|PythonUDF", plan)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert not re.search(r"windowspecdefinition\(specifiedwindowframe", plan)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SF)
    check_plan(result)
    columns = sorted(result.columns)
    rows = sorted(tuple(_cell(r[c]) for c in columns) for r in result.collect())
    if name not in SQL:
        assert rows
        return
    expected = duck.sql(SQL[name])
    assert sorted(expected.columns) == columns
    order = [expected.columns.index(c) for c in columns]
    assert rows == sorted(tuple(_cell(r[i]) for i in order) for r in expected.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
