"""The whole scan: choose columns, give them roles, profile each kind."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from gristmill.functions.roles import Roles, profile_roles, select_features
from gristmill.operators import categorical, cross, groups, numeric
from gristmill.plans.isolation import error_table, isolated
from gristmill.sources import files


@dataclass(frozen=True)
class Profile:
    """Lazy tables of one scan; those that do not apply are None."""

    roles: Roles
    num: DataFrame | None
    cat: DataFrame | None
    top: DataFrame | None
    cross: DataFrame | None
    medians: DataFrame | None
    errors: DataFrame | None = None


def _each(columns, build, failures):
    """The tables of ``build`` over the columns that can be read; None for none."""
    done, failed = isolated(columns, build)
    failures += failed
    return [reduce(DataFrame.unionByName, tables) for tables in zip(*done, strict=True)] or None


def summarize(
    df: DataFrame,
    features: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None,
    force_categorical: Sequence[str] | None = None,
    group: str | None = None,
    cross_pairs: Sequence[Sequence[str]] = (),
    columns_per_scan: int | None = None,
    isolate: bool = False,
) -> Profile:
    """The profile of one table, lazy. With ``isolate`` its parts are computed here, and a
    column that fails (an expression of a view that cannot be computed, a value that
    cannot be cast) is left out and listed in ``errors`` as ``(feature, problem)``;
    columns of pairs and groups that failed are left out there too."""
    if isolate:
        return _isolated(df, features, exclude, force_categorical, group, cross_pairs, columns_per_scan)
    table = select_features(df, features, exclude)
    roles = profile_roles(table, force_categorical)
    num = cat = top = crossed = medians = None
    if roles.numeric:
        num = numeric.num_profile(table, roles.numeric, columns_per_scan)
        if group is not None and group in table.columns:
            medians = groups.group_medians(table, roles.numeric, group, columns_per_scan=columns_per_scan)
    if roles.categorical:
        cat, top = categorical.cat_profile(table, roles.categorical, columns_per_scan=columns_per_scan)
    pairs = cross.known_pairs(table, cross_pairs)
    if pairs:
        crossed = cross.cross_coverage(cross.pair_counts(table, pairs))
    return Profile(roles, num, cat, top, crossed, medians)


def _isolated(df, features, exclude, force_categorical, group, cross_pairs, columns_per_scan) -> Profile:
    table = select_features(df, features, exclude)
    roles = profile_roles(table, force_categorical)
    failures: list[tuple[str, str]] = []
    num = _each(roles.numeric, lambda part: (numeric.num_profile(table, part, columns_per_scan),), failures)
    cat = _each(roles.categorical, lambda part: categorical.cat_profile(table, part, columns_per_scan=columns_per_scan), failures)
    failed = {name for name, _ in failures}
    sound = [c for c in roles.numeric if c not in failed]
    medians = crossed = None
    if sound and group is not None and group in table.columns and group not in failed:
        build = lambda part: (groups.group_medians(table, part, group, columns_per_scan=columns_per_scan),)
        medians = _each(sound, build, failures)
    pairs = [p for p in cross.known_pairs(table, cross_pairs) if not failed & set(p)]
    if pairs:
        crossed = cross.cross_coverage(cross.pair_counts(table, pairs))
    return Profile(
        roles,
        num[0] if num else None,
        cat[0] if cat else None,
        cat[1] if cat else None,
        crossed,
        medians[0] if medians else None,
        error_table(df.sparkSession, failures),
    )


def summarize_files(
    spark: SparkSession,
    directory: str,
    sample_ratio: float = 1.0,
    file_type: str | None = None,
    **options,
) -> Profile:
    """Profile a directory, optionally from a repeatable sample of its files. A column that
    fails is left out and listed, unless ``isolate=False`` is given."""
    options.setdefault("isolate", True)
    kind = files.resolve_file_type(spark, directory, file_type)
    chosen = files.sample_files(files.list_files(spark, directory, kind), sample_ratio)
    scan = files.scan_parquet if kind == "parquet" else files.scan_csv
    return summarize(scan(spark, chosen), **options)
