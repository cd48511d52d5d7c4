"""The feature job: align, fit on train, fill both frames, add the row mean."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gristmill.functions.roles import imputation_roles
from gristmill.operators import impute
from gristmill.operators.lookup import settled


def impute_and_row_mean(train: DataFrame, test: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Engineered ``(train, test)``. Every statistic comes from train alone; the
    target is neither filled nor averaged and stays the last column of train."""
    train, test, shared = impute.align(train, test, target)
    fitted = settled(impute.fit(train, shared))  # a row per column, read by both frames
    numbers = imputation_roles(train, ignore=[target]).numeric
    done = []
    for frame in (train, test):
        filled = impute.apply(frame, fitted, shared)
        if numbers:
            filled = impute.row_mean(filled, numbers)
        done.append(filled)
    engineered, tested = done
    if target in engineered.columns:
        ordered = [c for c in engineered.columns if c != target] + [target]
        engineered = engineered.select(*[f"`{c}`" for c in ordered])
    return engineered, tested
