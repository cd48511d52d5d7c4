"""Splits and leakage checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import leakage, splits, target_encoding
from registry.features import _OOF, _gappy_priority
from registry.tables import GAPS_SQL, bucket_sql, gaps, rounded, table


def dup_train_test(spark, d):
    documents = table(spark, d, "documents")
    test = documents.where(F.col("doc_id") % 5 == 0).select("text", "lang")
    train = documents.where(F.col("doc_id") % 5 != 0).select("text", "lang")
    return leakage.shared_rows(train, test)


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"]


def leak_target_corr(spark, d):
    lines = gaps(spark, d).withColumn("returned", (F.coalesce("l_returnflag", F.lit("N")) == "R").cast("int"))
    return rounded(leakage.target_correlation(lines, _CORR, "returned"), "correlation", "strength", places=6)


def leak_id_order(spark, d):
    # gaps, and ties on both sides: two orders share an id, prices are whole hundreds
    orders = table(spark, d, "orders").select(
        F.floor(F.col("o_orderkey") / 2).alias("o_orderkey"),
        F.when(F.col("o_custkey") % 5 != 0, F.floor(F.col("o_totalprice") / 100) * 100).alias("o_totalprice"),
    )
    return rounded(leakage.id_order(orders, "o_orderkey", "o_totalprice"), "correlation", "rank_correlation", places=6)


def leak_target_encoding(spark, d):
    made = target_encoding.out_of_fold(_gappy_priority(spark, d), "o_orderpriority", "o_totalprice", "o_orderkey", "te")
    split = splits.grouped(made, "o_custkey")
    return rounded(
        leakage.encoding_gap(split, "te", "o_totalprice"), "train_correlation", "valid_correlation", "gap", places=6
    )


def split_temporal(spark, d):
    return splits.temporal(table(spark, d, "events"), "ts").select("event_id", "split")


def split_group(spark, d):
    return splits.grouped(table(spark, d, "orders"), "o_custkey").select("o_orderkey", "o_custkey", "split")


def split_kfold(spark, d):
    return splits.kfold(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "fold")


QUERIES = {
    "dup_train_test": dup_train_test,
    "leak_target_corr": leak_target_corr,
    "leak_id_order": leak_id_order,
    "leak_target_encoding": leak_target_encoding,
    "split_temporal": split_temporal,
    "split_group": split_group,
    "split_kfold": split_kfold,
}

_Y = "(coalesce(l_returnflag, 'N') = 'R')::int"
_VALID = f"{bucket_sql('o_custkey', 5)} = 0"

SQL = {
    "dup_train_test": """select text, lang from documents where doc_id % 5 <> 0
        intersect select text, lang from documents where doc_id % 5 = 0""",
    "leak_target_corr": "\nunion all\n".join(
        f"""select '{c}' as feature, round(corr({c}, {_Y}), 6) as correlation, round(abs(corr({c}, {_Y})), 6) as strength
        from ({GAPS_SQL})"""
        for c in _CORR
    ),
    "leak_id_order": """
        with pairs as (select floor(o_orderkey / 2) as k, floor(o_totalprice / 100) * 100 as v from orders where o_custkey % 5 <> 0),
        ranks as (select k, v, rank() over (order by k) + (count(*) over (partition by k) - 1) / 2 as kr,
                         rank() over (order by v) + (count(*) over (partition by v) - 1) / 2 as vr from pairs)
        select 'o_orderkey' as id_column, round(corr(k, v), 6) as correlation, round(corr(kr, vr), 6) as rank_correlation
        from ranks""",
    "leak_target_encoding": _OOF + f""",
        made as (select r.*, (t.s - o.s) / nullif(t.n - o.n, 0) as te from rows r
          left join cats o on o.c = r.o_orderpriority and o.fold = r.fold
          left join (select c, sum(s) as s, sum(n) as n from cats group by 1) t on t.c = r.o_orderpriority),
        corrs as (select corr(te, o_totalprice) filter (where not {_VALID}) as tc,
                         corr(te, o_totalprice) filter (where {_VALID}) as vc from made)
        select round(tc, 6) as train_correlation, round(vc, 6) as valid_correlation, round(tc - vc, 6) as gap from corrs""",
    "split_temporal": """select event_id, case when epoch_us(ts) <= cut then 'train' else 'valid' end as split
        from events, (select quantile_cont(epoch_us(ts)::double, 0.8) as cut from events)""",
    "split_group": f"""select o_orderkey, o_custkey, case when {_VALID} then 'valid' else 'train' end as split from orders""",
    "split_kfold": f"select o_orderkey, {bucket_sql('o_orderkey', 5)} as fold from orders",
}
