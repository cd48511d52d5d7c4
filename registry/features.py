"""Feature preparation: imputation, encodings and recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import scalars
from gristmill.operators import binning, categorical, encode, groups, impute, numeric, target_encoding, timeline
from gristmill.plans import feature_job, report
from registry.profile import LINE_CAT, _LINE_LONG_SQL, _LINE_TEXT_SQL, _line_text
from registry.scan import _IMPUTED_TEST, _SPLIT, _orders_with_gaps, split_orders, top_sql
from registry.tables import EVENT_GAPS_SQL, GAPS_SQL, bucket_sql, event_gaps, gaps, rounded, table

_FIT = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def impute_fit(spark, d):
    train, _ = split_orders(_orders_with_gaps(spark, d))
    return impute.fit(train, _FIT)


def impute_apply(spark, d):
    train, test = split_orders(_orders_with_gaps(spark, d))
    return impute.apply(test, impute.fit(train, _FIT), _FIT).drop("o_totalprice")


def row_mean(spark, d):
    means = impute.row_mean(gaps(spark, d), ["l_quantity", "l_discount", "l_tax"])
    return means.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("row_mean"), 2).alias("total"), F.round(F.max("row_mean"), 4).alias("top")
    )


def impute_and_row_mean(spark, d):
    train, test = split_orders(_orders_with_gaps(spark, d))
    engineered, _ = feature_job.impute_and_row_mean(train, test, "o_totalprice")
    return rounded(engineered, "row_mean")


def group_agg_features(spark, d):
    # a fifth of the customers is unknown to train: their statistics stay null
    train, test = split_orders(table(spark, d, "orders"))
    train = train.where(F.col("o_custkey") % 5 != 0)
    joined = groups.group_aggregates(train, test, "o_custkey", "o_totalprice")
    made = [f"o_custkey_o_totalprice_{s}" for s in ("mean", "std", "count")]
    return rounded(joined.select("o_orderkey", *made), *made[:2], places=6)


def group_size(spark, d):
    return groups.group_size(event_gaps(spark, d), "user_id")


def group_nunique(spark, d):
    return groups.group_nunique(event_gaps(spark, d), "event_type", "user_id")


def ratio_to_group_mean(spark, d):
    train, test = split_orders(table(spark, d, "orders"))
    ratio = groups.ratio_to_group_mean(train, test, "o_orderpriority", "o_totalprice", "price_ratio")
    return rounded(ratio.select("o_orderkey", "price_ratio"), "price_ratio")


def lag_feature(spark, d):
    # small segments, so that every user's history is split and joined up again
    made = timeline.past_features(
        event_gaps(spark, d), "user_id", "ts", "event_id", "value", lags=[1], rows_per_segment=20
    )
    return made.select("event_id", "user_id", "value_lag1")


def rolling_mean_past(spark, d):
    # half of all rows share one second
    burst = F.when(F.col("event_id") % 2 == 0, F.to_timestamp_ntz(F.lit("2024-03-01 00:00:00"))).otherwise(F.col("ts").cast("timestamp_ntz"))
    made = timeline.past_features(
        event_gaps(spark, d).withColumn("ts", burst), "user_id", "ts", "event_id", "value", windows=[7], rows_per_segment=50
    )
    return rounded(made.select("event_id", "user_id", "value_roll7"), "value_roll7")


def encode_apply(spark, d):
    lines = _line_text(spark, d)
    encoding = encode.encoding_map(*categorical.cat_profile(lines, LINE_CAT))
    coded = encode.encode_apply(lines, encoding, "l_returnflag", "flag_id")
    coded = encode.encode_apply(coded, encoding, "l_shipdate", "date_id")
    return coded.groupBy("flag_id", "date_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


def standardize_apply(spark, d):
    lines = gaps(spark, d)
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    scaled = encode.standardize_apply(lines, report.std_params(numeric.num_profile(lines, columns)), columns)
    return scaled.groupBy("l_returnflag").agg(
        *[F.round(F.sum(f"{c}_std"), 2).alias(f"{c}_total") for c in columns],
        *[F.round(F.max(f"{c}_std"), 4).alias(f"{c}_top") for c in columns],
    )


def fillna_apply(spark, d):
    events = event_gaps(spark, d).select("event_id", "user_id", "event_type", "value")
    fills = report.fillna_map(
        numeric.num_profile(events, ["user_id", "value"]), *categorical.cat_profile(events, ["event_type"])
    )
    return encode.fillna_apply(events, fills, ["user_id", "event_type", "value"])


def _gappy_priority(spark, d):
    return table(spark, d, "orders").withColumn(
        "o_orderpriority", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    )


_GAPPY_PRIORITY_SQL = """select * replace (case when o_orderpriority <> '5-LOW' then o_orderpriority end
    as o_orderpriority) from orders"""


def target_encode_oof(spark, d):
    made = target_encoding.out_of_fold(_gappy_priority(spark, d), "o_orderpriority", "o_totalprice", "o_orderkey", "te")
    return rounded(made.select("o_orderkey", "te"), "te", places=2)


def target_encode_smoothed(spark, d):
    made = target_encoding.out_of_fold(
        _gappy_priority(spark, d), "o_orderpriority", "o_totalprice", "o_orderkey", "te", smoothing=20
    )
    return rounded(made.select("o_orderkey", "te"), "te", places=2)


def _unseen_low(spark, d):
    """Train without one priority, so test holds a category train never saw."""
    train, test = split_orders(table(spark, d, "orders"))
    return train.where(F.col("o_orderpriority") != "5-LOW"), test


def target_encode_test(spark, d):
    made = target_encoding.on_test(*_unseen_low(spark, d), "o_orderpriority", "o_totalprice", "te")
    return rounded(made.select("o_orderkey", "te"), "te", places=2)


def count_encode(spark, d):
    made = target_encoding.count_encode(*_unseen_low(spark, d), "o_orderpriority", "priority_count")
    return made.select("o_orderkey", "priority_count")


def qcut_bin(spark, d):
    binned = binning.qcut(event_gaps(spark, d), "value", "value_bin")
    return binned.select("event_id", "value_bin")


def interaction_numeric(spark, d):
    made = gaps(spark, d).withColumn("net", scalars.product(F.col("l_extendedprice"), F.col("l_discount")))
    return made.groupBy("l_linestatus").agg(F.count("net").alias("n"), F.round(F.sum("net"), 2).alias("total"))


def interaction_categorical(spark, d):
    made = gaps(spark, d).withColumn("both", scalars.joined_text(F.col("l_returnflag"), F.col("l_linestatus")))
    return made.groupBy("both").agg(F.count(F.lit(1)).alias("n"))


def datetime_parts(spark, d):
    return table(spark, d, "events").select("event_id", *scalars.datetime_parts(F.col("ts"), "ts"))


QUERIES = {
    "impute_fit": impute_fit,
    "impute_apply": impute_apply,
    "row_mean": row_mean,
    "impute_and_row_mean": impute_and_row_mean,
    "group_agg_features": group_agg_features,
    "group_size": group_size,
    "group_nunique": group_nunique,
    "ratio_to_group_mean": ratio_to_group_mean,
    "lag_feature": lag_feature,
    "rolling_mean_past": rolling_mean_past,
    "encode_apply": encode_apply,
    "standardize_apply": standardize_apply,
    "fillna_apply": fillna_apply,
    "target_encode_oof": target_encode_oof,
    "target_encode_smoothed": target_encode_smoothed,
    "target_encode_test": target_encode_test,
    "count_encode": count_encode,
    "qcut_bin": qcut_bin,
    "interaction_numeric": interaction_numeric,
    "interaction_categorical": interaction_categorical,
    "datetime_parts": datetime_parts,
}

_SIDES = f"select *, {_SPLIT} as side from orders"
_FOLD = bucket_sql("o_orderkey", 5)
_PAST = f"""select event_id, user_id,
    lag(value) over w as value_lag1,
    avg(value) over (partition by user_id order by ts, event_id rows between 7 preceding and 1 preceding) as roll
    from ({EVENT_GAPS_SQL}) window w as (partition by user_id order by ts, event_id)"""
_PAST_BURST = f"""select event_id, user_id,
    avg(value) over (partition by user_id order by case when event_id % 2 = 0 then timestamp '2024-03-01' else ts end, event_id
                     rows between 7 preceding and 1 preceding) as roll
    from ({EVENT_GAPS_SQL})"""
_UNSEEN = f"""with train as (select * from ({_SIDES}) where side = 'train' and o_orderpriority <> '5-LOW'),
    test as (select * from ({_SIDES}) where side = 'test')"""
_OOF = f"""with rows as (select *, {_FOLD} as fold from ({_GAPPY_PRIORITY_SQL})),
    cats as (select o_orderpriority as c, fold, sum(o_totalprice) as s, count(o_totalprice) as n
             from rows where o_orderpriority is not null group by 1, 2),
    folds as (select fold, sum(o_totalprice) as s, count(o_totalprice) as n from rows group by 1)"""


def _clipped_params(column: str) -> str:
    return f"""(select avg({column}) as m, stddev_samp({column}) as s from ({GAPS_SQL}),
        (select quantile_cont({column}, 0.01) as p1, quantile_cont({column}, 0.99) as p99 from ({GAPS_SQL}))
        where {column} between p1 and p99)"""


SQL = {
    "impute_fit": _IMPUTED_TEST + """
        select 'o_orderkey' as feature, 'median' as kind, k as number, null::varchar as text from fit
        union all select 'o_custkey', 'median', c, null from fit
        union all select 'o_orderstatus', 'most_frequent', null, s from fit
        union all select 'o_orderpriority', 'most_frequent', null, (select o_orderpriority from src where side = 'train'
            group by 1 order by count(*) desc, 1 limit 1)""",
    "impute_apply": _IMPUTED_TEST + """
        select o_orderkey::double as o_orderkey, coalesce(o_custkey::double, c) as o_custkey,
               coalesce(o_orderstatus, s) as o_orderstatus, o_orderpriority from src, fit where side = 'test'""",
    "row_mean": f"""select l_returnflag, count(*) as n, round(sum(m), 2) as total, round(max(m), 4) as top from (
        select l_returnflag, (l_quantity + coalesce(l_discount, 0) + coalesce(l_tax, 0))
          / ((l_quantity is not null)::int + (l_discount is not null)::int + (l_tax is not null)::int) as m
        from ({GAPS_SQL})) group by 1""",
    "impute_and_row_mean": _IMPUTED_TEST + """
        select o_orderkey::double as o_orderkey, coalesce(o_custkey::double, c) as o_custkey,
               coalesce(o_orderstatus, s) as o_orderstatus, o_orderpriority,
               round((o_orderkey + coalesce(o_custkey::double, c)) / 2, 4) as row_mean, o_totalprice
        from src, fit where side = 'train'""",
    "group_agg_features": f"""with rows as ({_SIDES}),
        stats as (select o_custkey, avg(o_totalprice) as m, stddev_samp(o_totalprice) as s, count(o_totalprice) as n
                  from rows where side = 'train' and o_custkey % 5 <> 0 group by 1)
        select o_orderkey, round(m, 6) as o_custkey_o_totalprice_mean, round(s, 6) as o_custkey_o_totalprice_std,
               n as o_custkey_o_totalprice_count
        from rows left join stats using (o_custkey) where side = 'test'""",
    "group_size": f"select user_id, count(*) as group_size from ({EVENT_GAPS_SQL}) where user_id is not null group by 1",
    "group_nunique": f"""select event_type, count(distinct user_id) as group_nunique from ({EVENT_GAPS_SQL})
        where event_type is not null group by 1""",
    "ratio_to_group_mean": f"""with rows as ({_SIDES})
        select o_orderkey, round(o_totalprice / m, 4) as price_ratio from rows left join
          (select o_orderpriority, avg(o_totalprice) as m from rows where side = 'train' group by 1) using (o_orderpriority)
        where side = 'test'""",
    "lag_feature": f"""select event_id, user_id, case when user_id is not null then value_lag1 end as value_lag1
        from ({_PAST})""",
    "rolling_mean_past": f"""select event_id, user_id, case when user_id is not null then round(roll, 4) end as value_roll7
        from ({_PAST_BURST})""",
    "encode_apply": f"""with lines as ({_LINE_TEXT_SQL}), top as ({top_sql(_LINE_LONG_SQL)})
        select coalesce(f.rank, 0) as flag_id, coalesce(t.rank, 0) as date_id, count(*) as n,
               sum(l_orderkey)::bigint as keys
        from lines left join (select value, rank from top where feature = 'l_returnflag') f on l_returnflag = f.value
        left join (select value, rank from top where feature = 'l_shipdate') t on l_shipdate::varchar = t.value
        group by 1, 2""",
    "standardize_apply": f"""select l_returnflag,
        round(sum((l_quantity - q.m) / q.s), 2) as l_quantity_total,
        round(sum((l_extendedprice - p.m) / p.s), 2) as l_extendedprice_total,
        round(sum((l_discount - d.m) / d.s), 2) as l_discount_total,
        round(max((l_quantity - q.m) / q.s), 4) as l_quantity_top,
        round(max((l_extendedprice - p.m) / p.s), 4) as l_extendedprice_top,
        round(max((l_discount - d.m) / d.s), 4) as l_discount_top
        from ({GAPS_SQL}), {_clipped_params('l_quantity')} q, {_clipped_params('l_extendedprice')} p,
             {_clipped_params('l_discount')} d group by 1""",
    "fillna_apply": f"""with src as ({EVENT_GAPS_SQL})
        select event_id, coalesce(user_id::double, (select quantile_cont(user_id::double, 0.5) from src)) as user_id,
          coalesce(event_type, (select event_type from src where event_type is not null
                                group by 1 order by count(*) desc, 1 limit 1)) as event_type,
          coalesce(value, (select quantile_cont(value, 0.5) from src)) as value from src""",
    "target_encode_oof": _OOF + """
        select o_orderkey, round((t.s - o.s) / nullif(t.n - o.n, 0), 2) as te from rows r
        left join cats o on o.c = r.o_orderpriority and o.fold = r.fold
        left join (select c, sum(s) as s, sum(n) as n from cats group by 1) t on t.c = r.o_orderpriority""",
    "target_encode_smoothed": _OOF + """
        select o_orderkey, round((t.s - o.s + 20 * (g.s - f.s) / (g.n - f.n)) / (t.n - o.n + 20), 2) as te from rows r
        left join cats o on o.c = r.o_orderpriority and o.fold = r.fold
        left join (select c, sum(s) as s, sum(n) as n from cats group by 1) t on t.c = r.o_orderpriority
        join folds f on f.fold = r.fold, (select sum(s) as s, sum(n) as n from folds) g""",
    "target_encode_test": _UNSEEN + """
        select o_orderkey, round(coalesce(m, (select avg(o_totalprice) from train)), 2) as te from test
        left join (select o_orderpriority, avg(o_totalprice) as m from train group by 1) using (o_orderpriority)""",
    "count_encode": _UNSEEN + """
        select o_orderkey, coalesce(n, 0) as priority_count from test
        left join (select o_orderpriority, count(*) as n from train group by 1) using (o_orderpriority)""",
    "qcut_bin": f"""with src as ({EVENT_GAPS_SQL}),
        edges as (select list_distinct(quantile_cont(value, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) as e from src)
        select event_id, case when value is not null
               then greatest(len(list_filter(e, lambda x: x < value)) - 1, 0)::bigint end as value_bin from src, edges""",
    "interaction_numeric": f"""select l_linestatus, count(l_extendedprice * l_discount) as n,
        round(sum(l_extendedprice * l_discount), 2) as total from ({GAPS_SQL}) group by 1""",
    "interaction_categorical": f"""select l_returnflag || '_' || l_linestatus as both, count(*) as n
        from ({GAPS_SQL}) group by 1""",
    "datetime_parts": """select event_id, year(ts) as ts_year, month(ts) as ts_month, day(ts) as ts_day,
        hour(ts) as ts_hour, isodow(ts) - 1 as ts_weekday, week(ts) as ts_week from events""",
}
