"""Inputs shared by the registered queries: the given tables, and variants with
nulls, constants and near-constants derived from them (the given tables have no
nulls). Every variant exists as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALL = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


# lineitem with gaps, a constant, a mostly-zero and a mostly-missing column
GAPS_NUM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "mostly_zero", "mostly_missing", "constant", "gappy_constant",
]
GAPS_CAT = ["l_returnflag", "l_linestatus"]


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").withColumns(
        {
            "l_discount": F.nullif("l_discount", F.lit(0.0)),
            "l_tax": F.nullif("l_tax", F.lit(0.0)),
            "l_returnflag": F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")),
            "mostly_zero": F.when(q == 50, q).otherwise(F.lit(0.0)),
            "mostly_missing": F.when(q >= 47, q),
            "constant": F.lit(1),
            "gappy_constant": F.when(q > 10, F.lit(7)),
        }
    )


GAPS_SQL = """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
       nullif(l_discount, 0) as l_discount, nullif(l_tax, 0) as l_tax,
       case when l_returnflag <> 'N' then l_returnflag end as l_returnflag, l_linestatus, l_shipdate,
       case when l_quantity = 50 then l_quantity else 0 end as mostly_zero,
       case when l_quantity >= 47 then l_quantity end as mostly_missing,
       1 as constant,
       case when l_quantity > 10 then 7 end as gappy_constant
from lineitem
"""


def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumns(
        {
            "event_type": F.when(F.col("event_type") != "error", F.col("event_type")),
            "value": F.when(F.col("value") >= 5, F.col("value")),
            "user_id": F.when(F.col("user_id") % 7 != 0, F.col("user_id")),
        }
    )


EVENT_GAPS_SQL = """
select event_id, ts,
       case when user_id % 7 <> 0 then user_id end as user_id,
       case when event_type <> 'error' then event_type end as event_type,
       case when value >= 5 then value end as value, props
from events
"""


def bucket_sql(key: str, buckets: int) -> str:
    return f"(('0x' || substr(md5(({key})::varchar), 1, 8))::bigint % {buckets})"


def union_sql(parts) -> str:
    return "\nunion all\n".join(parts)
