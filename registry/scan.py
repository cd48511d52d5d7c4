"""Sources, sinks, projections and filters."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill import scratch_path
from gristmill.functions.hashing import bucket_of
from gristmill.functions.roles import select_features
from gristmill.operators import categorical, cross, impute, numeric
from gristmill.operators.counts import text_counts
from gristmill.plans import feature_job, profile
from gristmill.sources import files, sinks
from registry.tables import (
    ALL, EVENT_GAPS_SQL, GAPS_SQL, bucket_sql, event_gaps, gaps, rounded, table, union_sql,
)

_ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
FILES = 10


def scan_parquet(spark, d):
    counts = [
        files.scan_parquet(spark, d, pattern=f"{name}.parquet").agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.lit(name).alias("table_name"), "n_rows")
        for name in ALL
    ]
    return reduce(DataFrame.unionByName, counts)


def _orders_with_gaps(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_totalprice") >= 1000, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderpriority",
    )


_ORDERS_WITH_GAPS_SQL = """
select o_orderkey, case when o_custkey % 5 <> 0 then o_custkey end as o_custkey,
       case when o_orderstatus <> 'P' then o_orderstatus end as o_orderstatus,
       case when o_totalprice >= 1000 then o_totalprice end as o_totalprice, o_orderpriority
from orders
"""


def scan_csv(spark, d):
    """Two header orders, quoted line breaks and blanks, and a column whose few odd values come late."""
    path = scratch_path(spark, "csv")
    note = F.when(F.col("o_orderkey") % 7 == 0, F.lit(' two\n"lines", ')).otherwise(F.col("o_orderpriority"))
    late = F.when(F.col("o_orderkey") % 1000 == 999, F.lit("x")).otherwise(F.col("o_orderkey").cast("string"))
    made = _orders_with_gaps(spark, d).na.fill("NA", ["o_orderstatus"]).withColumns({"note": note, "late": late})
    sinks.write_csv(made.where("o_orderkey % 2 = 0"), f"{path}/even")
    sinks.write_csv(made.where("o_orderkey % 2 = 1").select(*reversed(made.columns)), f"{path}/odd")
    return files.scan_csv(spark, path, missing=files.MISSING_WORDS)


def scan_project(spark, d):
    cut = files.scan_parquet(spark, d, ["l_returnflag", "l_quantity"], pattern="lineitem.parquet")
    return cut.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity"))


def _events_in_files(spark, d) -> str:
    """Events as ten files, each the rows of one stable bucket."""
    path = scratch_path(spark, "events")
    parted = table(spark, d, "events").withColumn("part", bucket_of(F.col("event_id"), FILES))
    parted.repartition("part").write.partitionBy("part").parquet(path)
    return path


def multi_file_union(spark, d):
    union = files.scan_parquet(spark, _events_in_files(spark, d))
    return union.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def sample_files(spark, d):
    listed = files.list_files(spark, _events_in_files(spark, d))
    return files.scan_parquet(spark, files.sample_files(listed, 0.3)).select("event_id", "event_type", "value")


_CHOSEN = sorted(random.Random(42).sample(range(FILES), 3))


def sample_rows(spark, d):
    return files.sample_rows(table(spark, d, "orders"), "o_orderkey", 0.3).select("o_orderkey", "o_totalprice")


def _event_profile(spark, d):
    return profile.summarize(
        event_gaps(spark, d), exclude=["props"], group="event_type", cross_pairs=[["event_type", "user_id"]]
    )


def _written_profile(spark, d):
    done = _event_profile(spark, d)
    path = scratch_path(spark, "profile")
    sinks.write_profile_json(path, done.num, (done.cat, done.top), done.cross, done.medians)
    return sinks.read_profile(spark, path)


def write_profile_json(spark, d):
    """The written numeric part and the written summary of the categorical part."""
    back = _written_profile(spark, d)
    num = back["num"].select("feature", F.lit("numeric").alias("kind"), *numeric.PROFILE_COLUMNS[1:])
    cat = back["cat"].withColumn("kind", F.lit("categorical"))
    both = num.unionByName(cat, allowMissingColumns=True)
    return rounded(both, *[c for c in numeric.PROFILE_COLUMNS if c != "feature"], "coverage")


def read_profile(spark, d):
    """Everything that grows with the data: kept values, kept pairs, medians of groups."""
    back = _written_profile(spark, d)
    part = lambda name, a, b, *rest: back[name].select(F.lit(name).alias("part"), a.alias("a"), b.alias("b"), *rest)
    top = part("top", F.col("feature"), F.col("value"), "rank", "count", "ratio")
    crossed = part("cross", F.col("a"), F.col("b"), "rank", "count", "ratio")
    medians = part("medians", F.col("feature"), F.col("group"), F.lit(None).cast("bigint").alias("rank"), F.lit(None).cast("bigint").alias("count"), F.col("median").alias("ratio"))
    return rounded(top.unionByName(crossed).unionByName(medians), "ratio")


def write_features_csv(spark, d):
    train, test = split_orders(_orders_with_gaps(spark, d))
    path = scratch_path(spark, "features")
    sinks.write_features_csv(*feature_job.impute_and_row_mean(train, test, "o_totalprice"), path)
    train = files.scan_csv(spark, f"{path}/train_engineered").withColumn("side", F.lit("train"))
    test = files.scan_csv(spark, f"{path}/test_engineered").withColumn("side", F.lit("test"))
    return rounded(train.unionByName(test, allowMissingColumns=True), "row_mean")


def split_orders(orders):
    """Test rows are one fifth by the stable hash of the order key."""
    held = bucket_of(F.col("o_orderkey"), 5) == 0
    return orders.where(~held), orders.where(held)


def pick_features(spark, d):
    cut = select_features(
        table(spark, d, "orders"), ["o_totalprice", "o_orderpriority", "o_orderkey", "o_custkey"], ["o_custkey"]
    )
    return cut.groupBy("o_orderpriority").agg(
        F.count("o_orderkey").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


def align_train_test(spark, d):
    train, test = split_orders(_orders_with_gaps(spark, d))
    train, test, _ = impute.align(train.drop("o_orderstatus"), test.withColumn("extra", F.lit(1)), "o_totalprice")
    return train.withColumn("side", F.lit("train")).unionByName(
        test.withColumn("side", F.lit("test")), allowMissingColumns=True
    )


def key_to_string(spark, d):
    """Profile keys are text: whole numbers, booleans and strings alike."""
    keyed = table(spark, d, "orders").select(
        F.col("o_custkey"), (F.col("o_totalprice") > 100000).alias("expensive"), F.col("o_orderstatus")
    )
    counts = text_counts(keyed, ["o_custkey", "expensive", "o_orderstatus"])
    return counts.select("feature", "value", F.col("n").alias("n_rows"))


def filter_not_null(spark, d):
    both = gaps(spark, d).where(F.col("l_discount").isNotNull() & F.col("l_returnflag").isNotNull())
    return both.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_discount"), 4).alias("total"))


def filter_clip_range(spark, d):
    kept = numeric.clip_to_range(gaps(spark, d), "l_extendedprice")
    return kept.groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high")
    )


def filter_high_cardinality(spark, d):
    counts = text_counts(table(spark, d, "part"), ["p_name", "p_brand", "p_type"])
    base = categorical.cat_base(counts)
    top = categorical.top_values(counts, base, max_distinct=30)
    return categorical.summarise(base, top, max_distinct=30).select("feature", "nunique", "skipped", "items_kept")


def filter_pair_limit(spark, d):
    pairs = [["o_orderpriority", "o_orderstatus"], ["o_orderstatus", "o_custkey"]]
    counts = cross.within_limit(cross.pair_counts(table(spark, d, "orders"), pairs), max_combinations=100)
    return counts.select("pair", "a", "b", "n")


QUERIES = {
    "scan_parquet": scan_parquet,
    "scan_csv": scan_csv,
    "scan_project": scan_project,
    "sample_files": sample_files,
    "sample_rows": sample_rows,
    "multi_file_union": multi_file_union,
    "write_profile_json": write_profile_json,
    "read_profile": read_profile,
    "write_features_csv": write_features_csv,
    "select_features": pick_features,
    "align_train_test": align_train_test,
    "key_to_string": key_to_string,
    "filter_not_null": filter_not_null,
    "filter_clip_range": filter_clip_range,
    "filter_high_cardinality": filter_high_cardinality,
    "filter_pair_limit": filter_pair_limit,
}

_SPLIT = f"case when {bucket_sql('o_orderkey', 5)} = 0 then 'test' else 'train' end"


def num_profile_sql(source: str, columns, where_mean: str = "x between p1 and p99") -> str:
    """Full numeric profile of ``columns`` of ``source``, one row per column."""
    parts = []
    for c in columns:
        parts.append(f"""
select '{c}' as feature, b.nunique, b.null_count, round(b.null_count / b.total, 4) as null_ratio, b.zero_count,
       round(b.zero_count / b.total, 4) as zero_ratio, m.mean, round(q.p50, 4) as median, m.std,
       round(b.low, 4) as min, round(b.high, 4) as max, round(q.p1, 4) as "P1", round(q.p10, 4) as "P10",
       round(q.p25, 4) as "P25", round(q.p50, 4) as "P50", round(q.p75, 4) as "P75", round(q.p90, 4) as "P90",
       round(q.p99, 4) as "P99"
from (select count(*) as total, count(*) - count({c}) as null_count,
             count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as nunique,
             count(*) filter (where {c} = 0) as zero_count, min({c})::double as low, max({c})::double as high
      from src) b,
     (select quantile_cont({c}::double, 0.01) as p1, quantile_cont({c}::double, 0.1) as p10,
             quantile_cont({c}::double, 0.25) as p25, quantile_cont({c}::double, 0.5) as p50,
             quantile_cont({c}::double, 0.75) as p75, quantile_cont({c}::double, 0.9) as p90,
             quantile_cont({c}::double, 0.99) as p99 from src) q,
     (select round(avg(x), 4) as mean, round(stddev_samp(x), 4) as std
      from (select {c}::double as x from src),
           (select quantile_cont({c}::double, 0.01) as p1, quantile_cont({c}::double, 0.99) as p99 from src)
      where {where_mean}) m""")
    return f"with src as ({source})\n" + union_sql(parts)


def cross_sql(pairs_source: str) -> str:
    """Kept b-values per a-value from a relation ``(pair, a, b)``."""
    return f"""
select pair, a, b, rk as rank, n as count, round(n / tot, 4) as ratio from (
  select pair, a, b, n, row_number() over (partition by pair, a order by n desc, b) as rk,
         sum(n) over (partition by pair, a order by n desc, b rows unbounded preceding) as cum,
         sum(n) over (partition by pair, a) as tot
  from (select pair, a, b, count(*) as n from ({pairs_source}) where a is not null and b is not null group by all))
where cum - n < 0.95 * tot
"""


def top_sql(long_source: str) -> str:
    """Kept top values from a relation ``(feature, value)`` of strings."""
    return f"""
select feature, value, rk as rank, n as count, n / total as ratio from (
  select feature, value, n, total,
         row_number() over (partition by feature order by value is null, n desc, value) as rk,
         sum(n) over (partition by feature order by value is null, n desc, value rows unbounded preceding) as cum
  from (select feature, value, n, sum(n) over (partition by feature) as total
        from (select feature, value, count(*) as n from ({long_source}) group by all)))
where value is not null and (rk <= 30 or cum - n < 0.95 * total)
"""


_EVENT_TYPES = f"select 'event_type' as feature, event_type as value from ({EVENT_GAPS_SQL})"
_IMPUTED_TEST = f"""
with src as (select *, {_SPLIT} as side from ({_ORDERS_WITH_GAPS_SQL})),
fit as (select quantile_cont(o_orderkey::double, 0.5) as k, quantile_cont(o_custkey::double, 0.5) as c,
  (select o_orderstatus from src where side = 'train' and o_orderstatus is not null
   group by 1 order by count(*) desc, 1 limit 1) as s from src where side = 'train')
"""

SQL = {
    "scan_parquet": union_sql([f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in ALL]),
    "scan_csv": f"""select *, case when o_orderkey % 7 = 0 then ' two' || chr(10) || '"lines", ' else o_orderpriority end as note,
        case when o_orderkey % 1000 = 999 then 'x' else o_orderkey::varchar end as late from ({_ORDERS_WITH_GAPS_SQL})""",
    "scan_project": "select l_returnflag, sum(l_quantity) as quantity from lineitem group by 1",
    "sample_files": f"""select event_id, event_type, value from events
        where {bucket_sql('event_id', FILES)} in ({', '.join(map(str, _CHOSEN))})""",
    "sample_rows": f"select o_orderkey, o_totalprice from orders where {bucket_sql('o_orderkey', 10000)} < 3000",
    "multi_file_union": "select event_type, count(*) as n, round(sum(value), 2) as total from events group by 1",
    "write_profile_json": f"""
        with top as ({top_sql(_EVENT_TYPES)})
        select feature, 'numeric' as kind, nunique, null_count, null_ratio, zero_count, zero_ratio, mean, median, std, min, max,
               {', '.join(f'"{q}"' for q in numeric.QUANTILE_NAMES)},
               null::boolean as skipped, null::double as coverage, null::bigint as items_kept
        from ({num_profile_sql(EVENT_GAPS_SQL, ["event_id", "user_id", "value"])})
        union all
        select 'event_type', 'categorical', count(distinct event_type) + max((event_type is null)::int),
               count(*) - count(event_type), round((count(*) - count(event_type)) / count(*), 4), null, null, null, null, null, null, null,
               {', '.join('null' for _ in numeric.QUANTILE_NAMES)}, false,
               round((select sum(count) from top) / count(*), 4), (select count(*) from top)
        from ({EVENT_GAPS_SQL})""",
    "read_profile": f"""
        select 'top' as part, feature as a, value as b, rank, count, round(ratio, 4) as ratio from ({top_sql(_EVENT_TYPES)})
        union all
        select 'cross', a, b, rank, count, ratio from ({cross_sql(
            f"select 'event_type__x__user_id' as pair, event_type as a, user_id::varchar as b from ({EVENT_GAPS_SQL})")})
        union all
        """ + union_sql(
        [
            f"""select 'medians', '{c}', event_type, null, null, round(quantile_cont({c}::double, 0.5), 4)
            from ({EVENT_GAPS_SQL}) where event_type is not null group by event_type"""
            for c in ("event_id", "user_id", "value")
        ]
    ),
    "write_features_csv": _IMPUTED_TEST + """
        select o_orderkey::double as o_orderkey, coalesce(o_custkey::double, c) as o_custkey,
               coalesce(o_orderstatus, s) as o_orderstatus, o_orderpriority,
               round((o_orderkey + coalesce(o_custkey::double, c)) / 2, 4) as row_mean,
               case when side = 'train' then o_totalprice end as o_totalprice, side
        from src, fit""",
    "select_features": """select o_orderpriority, count(o_orderkey) as n, round(sum(o_totalprice), 2) as total
        from orders group by 1""",
    "align_train_test": f"""
        select o_orderkey, o_custkey, o_orderpriority,
               case when side = 'train' then o_totalprice end as o_totalprice, side
        from (select *, {_SPLIT} as side from ({_ORDERS_WITH_GAPS_SQL}))""",
    "key_to_string": union_sql(
        [
            f"select '{f}' as feature, ({e})::varchar as value, count(*) as n_rows from orders group by 1, 2"
            for f, e in (("o_custkey", "o_custkey"), ("expensive", "o_totalprice > 100000"), ("o_orderstatus", "o_orderstatus"))
        ]
    ),
    "filter_not_null": f"""select l_returnflag, count(*) as n, round(sum(l_discount), 4) as total
        from ({GAPS_SQL}) where l_discount is not null and l_returnflag is not null group by 1""",
    "filter_clip_range": """
        select l_linestatus, count(*) as n, min(l_extendedprice) as low, max(l_extendedprice) as high
        from lineitem, (select quantile_cont(l_extendedprice, 0.01) as p1, quantile_cont(l_extendedprice, 0.99) as p99
                        from lineitem)
        where l_extendedprice between p1 and p99 group by 1""",
    "filter_high_cardinality": union_sql(
        [
            f"""select '{c}' as feature, n as nunique, n > 30 as skipped, case when n <= 30 then n end as items_kept
            from (select count(distinct {c}) as n from part)"""
            for c in ("p_name", "p_brand", "p_type")
        ]
    ),
    "filter_pair_limit": """
        select pair, a, b, n from (select *, count(*) over (partition by pair) as combos from (
            select 'o_orderpriority__x__o_orderstatus' as pair, o_orderpriority as a, o_orderstatus as b, count(*) as n
            from orders group by all
            union all
            select 'o_orderstatus__x__o_custkey', o_orderstatus, o_custkey::varchar, count(*) from orders group by all))
        where combos <= 100""",
}
