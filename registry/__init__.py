"""Registered queries and the SQL each is checked against, one module per area."""

from registry import audit, features, journal, leakage, profile, report, scan

MODULES = [scan, profile, report, features, leakage, journal, audit]


def all_queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def all_sql():
    return {k: v for m in MODULES for k, v in m.SQL.items()}
