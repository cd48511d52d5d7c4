"""Column roles, read from a schema without running a job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TEXT_LIKE = (T.StringType, T.CharType, T.VarcharType, T.BooleanType)


@dataclass(frozen=True)
class Roles:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)


def select_features(
    df: DataFrame, features: Sequence[str] | None = None, exclude: Sequence[str] | None = None
) -> DataFrame:
    """Wanted columns in table order; the scan then reads only those."""
    unwanted = set(exclude or ())
    wanted = None if features is None else set(features)
    kept = [c for c in df.columns if (wanted is None or c in wanted) and c not in unwanted]
    if not kept:
        raise ValueError("no feature column is left to profile")
    return df.select(*[quoted(c) for c in kept])


def profile_roles(df: DataFrame, force_categorical: Sequence[str] | None = None) -> Roles:
    """Profiling roles: forced and text-like columns are categorical, numbers
    numeric, everything else (dates, nested data) is skipped and listed."""
    forced = set(force_categorical or ())
    roles = Roles()
    for item in df.schema.fields:
        if item.name in forced or isinstance(item.dataType, _TEXT_LIKE):
            roles.categorical.append(item.name)
        elif isinstance(item.dataType, T.NumericType):
            roles.numeric.append(item.name)
        else:
            roles.skipped.append(item.name)
    return roles


def imputation_roles(df: DataFrame, ignore: Sequence[str] = ()) -> Roles:
    """Imputation roles: numbers are numeric, everything else categorical."""
    roles = Roles()
    for item in df.schema.fields:
        if item.name in ignore:
            continue
        numeric = isinstance(item.dataType, T.NumericType)
        (roles.numeric if numeric else roles.categorical).append(item.name)
    return roles


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
