"""Profiles: numeric, categorical, per group and across two columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.scalars import clock_micros
from gristmill.operators import categorical, cross, groups, numeric, sketches
from gristmill.operators.counts import text_counts
from gristmill.plans import profile
from registry.scan import cross_sql, num_profile_sql, top_sql
from registry.tables import (
    EVENT_GAPS_SQL, GAPS_NUM, GAPS_SQL, event_gaps, gaps, rounded, table, union_sql,
)

_FLOATS = [c for c in numeric.PROFILE_COLUMNS if c not in ("feature", "nunique", "null_count", "zero_count")]
# l_partkey and l_orderkey keep thousands of values
LINE_CAT = ["l_returnflag", "l_linestatus", "l_shipdate", "l_quantity", "l_partkey", "l_orderkey"]
PAIRS = [["l_returnflag", "l_quantity"], ["l_linestatus", "l_shipdate"], ["l_returnflag", "l_partkey"]]


def num_profile(spark, d):
    return rounded(numeric.num_profile(gaps(spark, d), GAPS_NUM), *_FLOATS)


def _only(*columns):
    return f"select feature, {', '.join(columns)} from ({num_profile_sql(GAPS_SQL, GAPS_NUM)})"


def num_base_stats(spark, d):
    return rounded(numeric.base_stats(gaps(spark, d), GAPS_NUM), "min", "max", "median")


def num_quantiles(spark, d):
    return rounded(numeric.quantiles(gaps(spark, d), GAPS_NUM), *numeric.QUANTILE_NAMES)


def num_clipped_moments(spark, d):
    return rounded(numeric.moments(gaps(spark, d), GAPS_NUM), "mean", "std")


def num_plain_stats(spark, d):
    return rounded(numeric.plain_stats(gaps(spark, d), GAPS_NUM), *_FLOATS)


def num_ratios(spark, d):
    return rounded(numeric.ratios(gaps(spark, d), GAPS_NUM), "null_ratio", "zero_ratio")


def row_count(spark, d):
    parts = [
        table(spark, d, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
        for t in ("lineitem", "orders", "events", "documents")
    ]
    return reduce(DataFrame.unionByName, parts)


def _line_text(spark, d):
    # dates as epoch seconds and quantities as whole numbers: both engines print those alike
    lines = gaps(spark, d)
    moment = clock_micros(F.col("l_shipdate"), lines.schema["l_shipdate"].dataType)
    return lines.withColumns(
        {
            "l_shipdate": F.floor(moment / 1_000_000).cast("bigint"),
            "l_quantity": F.col("l_quantity").cast("int"),
        }
    )


_LINE_TEXT_SQL = f"""select * replace (epoch(l_shipdate)::bigint as l_shipdate, l_quantity::int as l_quantity)
from ({GAPS_SQL})"""
_LINE_LONG_SQL = union_sql(
    [f"select '{c}' as feature, {c}::varchar as value from ({_LINE_TEXT_SQL})" for c in LINE_CAT]
)
_BASE_SQL = f"""select feature, sum(n)::bigint as total_rows,
    coalesce(sum(n) filter (where value is null), 0)::bigint as null_count, count(*) as nunique
    from (select feature, value, count(*) as n from ({_LINE_LONG_SQL}) group by all) group by feature"""


def value_counts(spark, d):
    return text_counts(_line_text(spark, d), LINE_CAT).select("feature", "value", F.col("n").alias("n_rows"))


def cat_base_stats(spark, d):
    return categorical.cat_base(text_counts(_line_text(spark, d), LINE_CAT))


def cat_topn_coverage(spark, d):
    _, top = categorical.cat_profile(_line_text(spark, d), LINE_CAT)
    return rounded(top, "ratio", places=8)


def cat_profile(spark, d):
    summary, _ = categorical.cat_profile(_line_text(spark, d), LINE_CAT)
    return rounded(summary, "null_ratio", "coverage")


def group_median(spark, d):
    return groups.group_medians(event_gaps(spark, d), ["value"], "user_id", keep_empty=False).select("group", "median")


def group_medians_all(spark, d):
    # a group whose values are all missing keeps a null median
    holed = event_gaps(spark, d).withColumn("value", F.when(F.col("user_id") != 3, F.col("value")))
    return groups.group_medians(holed, ["value", "event_id"], "user_id")


_HOLED_SQL = f"""select event_id, user_id, event_type, case when user_id <> 3 then value end as value
    from ({EVENT_GAPS_SQL})"""


def _pair_counts(spark, d):
    return cross.pair_counts(_line_text(spark, d), PAIRS)


def cross_combinations(spark, d):
    return cross.combinations(_pair_counts(spark, d))


def cross_counts(spark, d):
    return cross.with_totals(_pair_counts(spark, d))


def cross_coverage(spark, d):
    kept = cross.cross_coverage(_pair_counts(spark, d))
    return rounded(kept, "ratio")


def summarize(spark, d):
    """The whole scan of one table as long rows ``(part, feature, item, number)``."""
    done = profile.summarize(
        event_gaps(spark, d), exclude=["props"], group="event_type", cross_pairs=[["event_type", "user_id"]]
    )
    parts = [
        done.num.select(F.lit("median").alias("part"), "feature", F.lit(None).cast("string").alias("item"), F.col("median").alias("number")),
        done.medians.select(F.lit("group_median").alias("part"), "feature", F.col("group").alias("item"), F.col("median").alias("number")),
        done.top.select(F.lit("top").alias("part"), "feature", F.col("value").alias("item"), F.col("ratio").alias("number")),
        done.cross.select(F.lit("cross").alias("part"), F.col("a").alias("feature"), F.col("b").alias("item"), F.col("ratio").alias("number")),
    ]
    return rounded(reduce(DataFrame.unionByName, parts), "number")


def num_profile_isolated(spark, d):
    """A profile of a view two of whose columns cannot be computed: they are listed."""
    q = F.col("l_quantity")
    broken = gaps(spark, d).select(
        *GAPS_NUM,
        (q / F.when(q == 13, 0).otherwise(1)).alias("divided"),
        F.when(q == 13, F.lit("many")).otherwise("1").cast("int").alias("typed"),
    )
    done = profile.summarize(broken, isolate=True)
    empty = {c: F.lit(None).cast(done.num.schema[c].dataType) for c in numeric.PROFILE_COLUMNS[1:]}
    failed = done.errors.withColumns(empty)
    return rounded(done.num.withColumn("problem", F.lit(None).cast("string")).unionByName(failed), *_FLOATS)


#: Approximate quantiles lie between the exact ones this far aside in rank.
_ASIDE = 0.01


def num_profile_approx(spark, d):
    """Sketches of 16 parts, merged: exact figures, and whether the others are near."""
    lines = gaps(spark, d)
    near = sketches.profile(sketches.sketch(lines, GAPS_NUM, F.pmod("l_orderkey", F.lit(16)).cast("string")))
    sides = [
        (f"{name}_{side}", min(max(p + step, 0.0), 1.0))
        for p, name in zip(numeric.QUANTILES, numeric.QUANTILE_NAMES, strict=True)
        for side, step in (("from", -_ASIDE), ("to", _ASIDE))
    ]
    bounds = numeric.quantiles(lines, GAPS_NUM, [p for _, p in sides], [n for n, _ in sides])
    exact = numeric.base_stats(lines, GAPS_NUM).select("feature", F.col("nunique").alias("n_exact"))
    # one row per column
    both = near.join(F.broadcast(bounds), "feature").join(F.broadcast(exact), "feature")
    held = [F.col(n).between(F.col(f"{n}_from"), F.col(f"{n}_to")) for n in numeric.QUANTILE_NAMES]
    shown = both.select(
        *["feature", "null_count", "null_ratio", "zero_count", "zero_ratio", "min", "max", "mean"],
        reduce(lambda a, b: a & b, held).alias("quantiles_near"),
        (F.abs(F.col("nunique") - F.col("n_exact")) <= 0.04 * F.col("n_exact")).alias("nunique_near"),
    )
    return rounded(shown, "null_ratio", "zero_ratio", "min", "max", "mean")


QUERIES = {
    "num_profile": num_profile,
    "num_profile_isolated": num_profile_isolated,
    "num_profile_approx": num_profile_approx,
    "num_base_stats": num_base_stats,
    "num_quantiles": num_quantiles,
    "num_clipped_moments": num_clipped_moments,
    "num_plain_stats": num_plain_stats,
    "num_ratios": num_ratios,
    "row_count": row_count,
    "value_counts": value_counts,
    "cat_base_stats": cat_base_stats,
    "cat_topn_coverage": cat_topn_coverage,
    "cat_profile": cat_profile,
    "group_median": group_median,
    "group_medians_all": group_medians_all,
    "cross_combinations": cross_combinations,
    "cross_counts": cross_counts,
    "cross_coverage": cross_coverage,
    "summarize": summarize,
}

_PAIR_ROWS = union_sql(
    [f"select '{a}__x__{b}' as pair, {a}::varchar as a, {b}::varchar as b from ({_LINE_TEXT_SQL})" for a, b in PAIRS]
)
_PAIR_COUNTS = f"""select pair, a, b, count(*) as n from ({_PAIR_ROWS})
    where a is not null and b is not null group by all"""

_UNKNOWN = ", ".join(f'null as "{c}"' for c in numeric.PROFILE_COLUMNS[1:])
_FAILED = " ".join(
    f"""union all by name select '{name}' as feature, {_UNKNOWN}, '{problem}' as problem
        from (select 1 from lineitem where l_quantity = 13 limit 1)"""
    for name, problem in (("divided", "DIVIDE_BY_ZERO"), ("typed", "CAST_INVALID_INPUT"))
)

SQL = {
    "num_profile": num_profile_sql(GAPS_SQL, GAPS_NUM),
    "num_profile_isolated": f"select *, null::varchar as problem from ({num_profile_sql(GAPS_SQL, GAPS_NUM)}) {_FAILED}",
    "num_profile_approx": union_sql(
        [
            f"""select '{c}' as feature, count(*) - count({c}) as null_count,
            round((count(*) - count({c})) / count(*), 4) as null_ratio, count(*) filter (where {c} = 0) as zero_count,
            round(count(*) filter (where {c} = 0) / count(*), 4) as zero_ratio, round(min({c})::double, 4) as min,
            round(max({c})::double, 4) as max, round(avg({c}::double), 4) as mean, true as quantiles_near,
            true as nunique_near from ({GAPS_SQL})"""
            for c in GAPS_NUM
        ]
    ),
    "num_base_stats": _only("null_count", "nunique", "min", "max", "zero_count", "median"),
    "num_quantiles": _only(*[f'"{n}"' for n in numeric.QUANTILE_NAMES]),
    "num_clipped_moments": _only("mean", "std"),
    "num_plain_stats": num_profile_sql(GAPS_SQL, GAPS_NUM, "true"),
    "num_ratios": _only("null_count", "null_ratio", "zero_count", "zero_ratio"),
    "row_count": union_sql(
        [f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in ("lineitem", "orders", "events", "documents")]
    ),
    "value_counts": f"select feature, value, count(*) as n_rows from ({_LINE_LONG_SQL}) group by all",
    "cat_base_stats": _BASE_SQL,
    "cat_topn_coverage": f"select feature, value, rank, count, round(ratio, 8) as ratio from ({top_sql(_LINE_LONG_SQL)})",
    "cat_profile": f"""select b.feature, b.nunique, b.null_count, round(b.null_count / b.total_rows, 4) as null_ratio,
        false as skipped, round(t.covered / b.total_rows, 4) as coverage, t.items_kept
        from ({_BASE_SQL}) b join (select feature, sum(count) as covered, count(*) as items_kept
                                   from ({top_sql(_LINE_LONG_SQL)}) group by 1) t using (feature)""",
    "group_median": f"""select user_id::varchar as group, quantile_cont(value, 0.5) as median
        from ({EVENT_GAPS_SQL}) where user_id is not null and value is not null group by 1""",
    "group_medians_all": union_sql(
        [
            f"""select '{c}' as feature, user_id::varchar as group, quantile_cont({c}::double, 0.5) as median
            from ({_HOLED_SQL}) where user_id is not null group by 2"""
            for c in ("value", "event_id")
        ]
    ),
    "cross_combinations": f"select pair, count(*) as combinations from ({_PAIR_COUNTS}) group by 1",
    "cross_counts": f"""select pair, a, b, n, (sum(n) over (partition by pair, a))::bigint as a_rows
        from ({_PAIR_COUNTS})""",
    "cross_coverage": cross_sql(_PAIR_ROWS),
    "summarize": union_sql(
        [
            f"""select 'median' as part, '{c}' as feature, null::varchar as item,
            round(quantile_cont({c}::double, 0.5), 4) as number from ({EVENT_GAPS_SQL})"""
            for c in ("event_id", "user_id", "value")
        ]
        + [
            f"""select 'group_median', '{c}', event_type, round(quantile_cont({c}::double, 0.5), 4)
            from ({EVENT_GAPS_SQL}) where event_type is not null group by event_type"""
            for c in ("event_id", "user_id", "value")
        ]
        + [
            f"""select 'top', feature, value, round(ratio, 4)
            from ({top_sql(f"select 'event_type' as feature, event_type as value from ({EVENT_GAPS_SQL})")})""",
            f"""select 'cross', a, b, ratio from ({cross_sql(
                f"select 'p' as pair, event_type as a, user_id::varchar as b from ({EVENT_GAPS_SQL})")})""",
        ]
    ),
}
