"""Config maps and report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill import scratch_path
from gristmill.functions import scalars
from gristmill.operators import categorical, cross, encode, numeric
from gristmill.operators.cross import PAIR_SEPARATOR, pair_name
from gristmill.plans import report
from gristmill.sources import sinks
from registry.profile import _BASE_SQL, _LINE_LONG_SQL, _PAIR_ROWS, LINE_CAT, PAIRS, _line_text, _pair_counts
from registry.scan import cross_sql, num_profile_sql, top_sql
from registry.tables import GAPS_NUM, GAPS_SQL, gaps, rounded, union_sql

_NUM_SQL = num_profile_sql(GAPS_SQL, GAPS_NUM)
_TOP_SQL = top_sql(_LINE_LONG_SQL)
_CROSS_SQL = cross_sql(_PAIR_ROWS)


def _num(spark, d):
    return numeric.num_profile(gaps(spark, d), GAPS_NUM)


def _cat(spark, d):
    return categorical.cat_profile(_line_text(spark, d), LINE_CAT)


def _handed_over(spark, **parts):
    """As in use: the scan writes its profile, maps and reports are made from what it wrote."""
    path = scratch_path(spark, "profile")
    sinks.write_profile_json(path, **parts)
    return sinks.read_profile(spark, path)


def flatten_cat(spark, d):
    return rounded(report.flatten_cat(*_cat(spark, d)), "null_ratio")


def flatten_num(spark, d):
    return rounded(report.flatten_num(_num(spark, d)), *[c for c in numeric.PROFILE_COLUMNS if c != "feature"])


def flatten_cross(spark, d):
    return report.flatten_cross(cross.cross_coverage(_pair_counts(spark, d)))


def drop_rules(spark, d):
    return report.drop_list(_num(spark, d))


def embedding_dim(spark, d):
    return report.embedding_dims(_cat(spark, d)[0])


def fill_strategy(spark, d):
    return report.fill_strategies(_cat(spark, d)[0])


def fillna_map(spark, d):
    back = _handed_over(spark, num=_num(spark, d), cat=_cat(spark, d))
    fills = report.fillna_map(back["num"], back["cat"], back["top"])
    # numbers print differently in either engine: compare them as numbers
    return fills.select(
        "feature",
        "kind",
        F.when(F.col("kind") == "text", F.col("fill_value")).alias("fill_text"),
        F.when(F.col("kind") == "number", F.round(F.col("fill_value").cast("double"), 4)).alias("fill_number"),
    )


def std_params(spark, d):
    return rounded(report.std_params(_num(spark, d)), "mean", "std")


def encoding_map(spark, d):
    return encode.encoding_map(*_cat(spark, d))


def encoding_map_cross(spark, d):
    back = _handed_over(spark, cat=_cat(spark, d), cross=cross.cross_coverage(_pair_counts(spark, d)))
    maps = encode.encoding_maps(back["cat"], back["top"], LINE_CAT, back["cross"], PAIRS)
    children = [b for _, b in PAIRS]
    return reduce(DataFrame.unionByName, [maps[c] for c in children])


def pair_key_split(spark, d):
    named = cross.combinations(_pair_counts(spark, d))
    parts = F.split("pair", PAIR_SEPARATOR)
    return named.select("pair", parts[0].alias("parent"), parts[1].alias("child"), "combinations")


def analyze(spark, d):
    made = report.analyze(_num(spark, d), *_cat(spark, d))
    shares = F.array_join(F.transform("top_ratios", lambda r: scalars.decimals(r, 4)), ", ")
    return rounded(
        made.withColumns({"top_categories": F.array_join("top_categories", ", "), "top_ratios": shares}),
        "null_ratio", "zero_ratio", "mean", "std", "min", "max",
    )


def write_maps(spark, d):
    """The four maps as written and read back, one row per entry."""
    path = scratch_path(spark, "maps")
    num, (cat, top) = _num(spark, d), _cat(spark, d)
    sinks.write_maps(
        path,
        encoding_map=encode.encoding_map(cat, top),
        fill_na_map=report.fillna_map(num, cat, top),
        numerical_stats=report.std_params(num),
        embedding_dims=report.embedding_dims(cat),
    )
    back = sinks.read_maps(spark, path)
    none = F.lit(None).cast("double")
    is_text = F.col("kind") == "text"
    row = lambda name, key, a, b=none: back[name].select(F.lit(name).alias("map"), "feature", key.alias("key"), a.cast("double").alias("a"), b.cast("double").alias("b"))  # noqa: E731, E501
    parts = [
        row("encoding_map", F.col("value"), F.col("id")),
        row("fill_na_map", F.when(is_text, F.col("fill_value")), F.when(~is_text, F.col("fill_value"))),
        row("numerical_stats", F.lit(None).cast("string"), F.col("mean"), F.col("std")),
        row("embedding_dims", F.lit(None).cast("string"), F.col("nunique"), F.col("embedding_dim")),
    ]
    return rounded(reduce(DataFrame.unionByName, parts), "a", "b")


def report_rows(spark, d):
    back = _handed_over(spark, num=_num(spark, d), cat=_cat(spark, d))
    return report.report_rows(back["num"], back["cat"], back["top"], GAPS_NUM, LINE_CAT)


QUERIES = {
    "flatten_cat": flatten_cat,
    "flatten_num": flatten_num,
    "flatten_cross": flatten_cross,
    "drop_rules": drop_rules,
    "embedding_dim": embedding_dim,
    "fill_strategy": fill_strategy,
    "fillna_map": fillna_map,
    "std_params": std_params,
    "encoding_map": encoding_map,
    "encoding_map_cross": encoding_map_cross,
    "pair_key_split": pair_key_split,
    "analyze": analyze,
    "report_rows": report_rows,
    "write_maps": write_maps,
}

_DIM = """case when nunique <= 10 then least(4, nunique) when nunique <= 50 then least(8, nunique)
    when nunique <= 100 then least(16, nunique) else least(32, floor(sqrt(nunique))::bigint) end"""
_REASON = """case when null_ratio > 0.9 then 'missing' when nunique = 1 then 'constant'
    when zero_ratio > 0.95 then 'zeros' end"""
_RATIO_BASE = f"select *, null_count / total_rows as null_ratio from ({_BASE_SQL})"


def _dec(expr: str, places: int) -> str:
    return f"round({expr}, {places})::decimal(38,{places})::varchar"


def _position(columns) -> str:
    return f"list_position([{', '.join(repr(c) for c in columns)}], feature)::bigint"


def _child_sql(parent: str, child: str) -> str:
    """Ids within a pair: children as first seen, then one per parent, then OTH."""
    pair = pair_name(parent, child)
    return f"""
    select '{child}' as feature, value, max(id) as id from (
      with kept as (select * from ({_CROSS_SQL}) where pair = '{pair}'
                    and a in (select value from ({_TOP_SQL}) where feature = '{parent}' union all select 'OTH')),
      places as (select a, row_number() over (order by max(count) desc, a) as place from kept group by a),
      firsts as (select b, min((place, rank)) as seen from kept join places using (a) group by b)
      select b as value, row_number() over (order by seen) - 1 as id from firsts
      union all
      select a || '-OTH', (select count(*) from firsts) + place - 1 from places
      union all
      select 'OTH', (select count(*) from firsts) + (select count(*) from places))
    group by value"""


SQL = {
    "flatten_cat": f"""
        select b.feature, b.nunique, b.null_count, round(b.null_ratio, 4) as null_ratio, p.top10_preview, false as skipped
        from ({_RATIO_BASE}) b join (
          select feature, string_agg(value || ': ' || count || ' (' || {_dec('ratio', 4)} || ')', '; ' order by rank)
                 as top10_preview from ({_TOP_SQL}) where rank <= 10 group by 1) p using (feature)""",
    "flatten_num": _NUM_SQL,
    "flatten_cross": f"""
        with kept as ({cross_sql(_PAIR_ROWS).replace('round(n / tot, 4)', 'n / tot')}),
        places as (select pair, a, row_number() over (partition by pair order by max(count) desc, a) as place
                   from kept group by pair, a)
        select pair, total_a, total_items, preview
        from (select pair, count(distinct a) as total_a, count(*) as total_items from kept group by pair)
        join (select pair, string_agg(txt, '; ' order by place) as preview from (
                select pair, place, a || ': [' || string_agg(b || '(' || {_dec('ratio', 4)} || ')', ', ' order by rank) || ']' as txt
                from kept join places using (pair, a) where place <= 3 and rank <= 3 group by pair, place, a)
              group by pair) using (pair)""",
    "drop_rules": f"select feature, reason from (select feature, {_REASON} as reason from ({_NUM_SQL})) where reason is not null",
    "embedding_dim": f"select feature, nunique, {_DIM} as embedding_dim from ({_BASE_SQL})",
    "fill_strategy": f"select feature, case when null_count > 0 then 'mode' else 'none' end as strategy from ({_BASE_SQL})",
    "fillna_map": f"""
        select feature, 'number' as kind, null::varchar as fill_text,
               case when mean = 0 and std = 0 then 0.0::double else median end as fill_number
        from ({_NUM_SQL}) where null_count > 0
        union all
        select feature, 'text', coalesce(value, 'unknown'), null
        from (select feature from ({_BASE_SQL}) where null_count > 0)
        left join (select feature, value from ({_TOP_SQL}) where rank = 1) using (feature)""",
    "std_params": f"select feature, mean, std from ({_NUM_SQL})",
    "encoding_map": f"""select feature, value, rank as id from ({_TOP_SQL}) where value <> 'OTH'
        union all select feature, 'OTH', 0 from ({_BASE_SQL})""",
    "encoding_map_cross": union_sql([_child_sql(a, b) for a, b in PAIRS]),
    "pair_key_split": f"""select pair, split_part(pair, '__x__', 1) as parent, split_part(pair, '__x__', 2) as child,
        count(*) as combinations from (select distinct * from ({_PAIR_ROWS}) where a is not null and b is not null) group by pair""",
    "analyze": f"""
        select feature, 'numeric' as kind, nunique, null_ratio, zero_ratio, mean, std, min, max, {_REASON} as drop_reason,
               null::bigint as embedding_dim, null::varchar as fill_strategy, null::varchar as top_categories,
               null::varchar as top_ratios from ({_NUM_SQL})
        union all
        select feature, 'categorical', nunique, round(null_ratio, 4), null, null, null, null, null, null, {_DIM},
               case when null_count > 0 then 'mode' else 'none' end, vals, shares
        from ({_RATIO_BASE}) left join (
          select feature, string_agg(value, ', ' order by rank) as vals, string_agg({_dec('ratio', 4)}, ', ' order by rank) as shares
          from ({_TOP_SQL}) where rank <= 10 group by feature) using (feature)""",
    "report_rows": f"""
        with num as ({_NUM_SQL}), base as ({_RATIO_BASE}), top as ({_TOP_SQL})
        select 'features' as section, 1::bigint as position, '- numeric: ' || count(*) as line from num
        union all
        select 'features', 2, '- categorical: ' || count(*) from base
        union all
        select 'drop' as section, {_position(GAPS_NUM)} as position, '- **' || feature || '**: ' || reason as line
        from (select feature, {_REASON} as reason from num) where reason is not null
        union all
        select 'numeric', {_position(GAPS_NUM)},
               '| ' || concat_ws(' | ', feature, {_dec('null_ratio * 100', 2)} || '%', {_dec('zero_ratio * 100', 2)} || '%',
               nunique, {_dec('mean', 2)}, {_dec('std', 2)}, {_dec('min', 2)}, {_dec('max', 2)}) || ' |'
        from num where {_position(GAPS_NUM)} <= 10
        union all
        select 'categorical', {_position(LINE_CAT)},
               '| ' || concat_ws(' | ', b.feature, {_dec('b.null_ratio * 100', 2)} || '%', b.nunique, t.vals, t.shares) || ' |'
        from base b join (select feature, string_agg(value, ', ' order by rank) as vals,
               string_agg({_dec('ratio * 100', 1)} || '%', ', ' order by rank) as shares
               from top where rank <= 3 group by feature) t using (feature)
        union all
        select 'embedding', {_position(LINE_CAT)}, '| ' || concat_ws(' | ', feature, nunique, {_DIM}) || ' |' from base""",
    "write_maps": f"""
        select 'encoding_map' as map, feature, value as key, id::double as a, null::double as b from (
            select feature, value, rank as id from ({_TOP_SQL}) where value <> 'OTH'
            union all select feature, 'OTH', 0 from ({_BASE_SQL}))
        union all
        select 'fill_na_map', feature, null, case when mean = 0 and std = 0 then 0.0::double else round(median, 4) end, null
        from ({_NUM_SQL}) where null_count > 0
        union all
        select 'fill_na_map', feature, coalesce(value, 'unknown'), null, null
        from (select feature from ({_BASE_SQL}) where null_count > 0)
        left join (select feature, value from ({_TOP_SQL}) where rank = 1) using (feature)
        union all
        select 'numerical_stats', feature, null, mean, std from ({_NUM_SQL})
        union all
        select 'embedding_dims', feature, null, nunique::double, ({_DIM})::double from ({_BASE_SQL})""",
}
