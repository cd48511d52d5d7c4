"""Experiment journal. The records are derived from ``events``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill import scratch_path
from gristmill.operators import journal as ops
from gristmill.plans import submission
from gristmill.sources import files, sinks
from registry.tables import ALL, table, union_sql


def records(spark, d):
    """One record per event; an error is a bug, some verdicts and metrics are missing."""
    e = table(spark, d, "events")
    bug = F.when(F.col("event_id") % 13 != 0, F.col("event_type") == "error")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.concat(F.lit("sub_"), "event_id").alias("submission_id"),
        bug.alias("is_bug"),
        F.when((F.col("event_type") != "error") & (F.col("event_id") % 11 != 0), F.col("value")).alias("metric"),
        (F.col("user_id") % 2 == 0).alias("lower_is_better"),
        F.concat("event_type", F.lit(" run")).alias("summary"),
        F.when(
            F.col("event_id") > 0, F.concat(F.lit("sub_"), F.floor((F.col("event_id") - 1) / 2).cast("bigint"))
        ).alias("parent_id"),
        F.when(F.col("event_id") % 17 != 0, F.array("event_type")).alias("tags"),
        F.concat(F.lit("task_"), "user_id").alias("task_id"),
    )


_RECORDS = """select strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as timestamp, 'sub_' || event_id as submission_id,
    case when event_id % 13 <> 0 then event_type = 'error' end as is_bug,
    case when event_type <> 'error' and event_id % 11 <> 0 then value end as metric,
    user_id % 2 = 0 as lower_is_better, event_type || ' run' as summary,
    case when event_id > 0 then 'sub_' || ((event_id - 1) // 2) end as parent_id,
    case when event_id % 17 <> 0 then [event_type] end as tags, 'task_' || user_id as task_id from events"""


def _one_task(spark, d):
    """Parents cross users, so the whole tree is one task."""
    return records(spark, d).withColumn("task_id", F.lit("task_all"))


def _lines(spark, d):
    """The records as JSON lines, with a malformed and a blank line per record."""
    whole = records(spark, d).select(F.to_json(F.struct("*")).alias("line"))
    noisy = F.array("line", F.concat(F.lit("{broken "), "line"), F.lit("   "))
    return whole.select(F.explode(noisy).alias("value"))


def _shown(df):
    return df.withColumn("tags", F.array_join("tags", ","))


def journal_load(spark, d):
    return _shown(ops.parse_lines(_lines(spark, d)))


def journal_append(spark, d):
    """Two appends of half the records each, read back as one journal."""
    path = scratch_path(spark, "journal")
    half = F.pmod(F.xxhash64("submission_id"), F.lit(2)) == 0
    everything = records(spark, d)
    sinks.journal_append(everything.where(half), path)
    sinks.journal_append(everything.where(~half), path)
    return _shown(sinks.journal_load(spark, path))


def journal_markdown(spark, d):
    # metrics print differently in either engine: shown here to whole numbers
    whole = records(spark, d).withColumn("metric", F.floor("metric").cast("bigint"))
    return ops.markdown(whole)


def history_status(spark, d):
    kept = ops.with_status(records(spark, d), "success").select("submission_id", F.lit("success").alias("status"))
    return kept.unionByName(ops.with_status(records(spark, d), "buggy").select("submission_id", F.lit("buggy").alias("status")))


def history_tag(spark, d):
    return ops.with_tag(records(spark, d), "click").select("task_id", "submission_id", "metric")


def history_topk(spark, d):
    return ops.latest(records(spark, d)).select("timestamp", "submission_id", "task_id", "metric")


def history_topk_per_task(spark, d):
    newest = ops.latest_per_task(records(spark, d), 20)
    return newest.select("task_id", F.col("place").cast("bigint").alias("place"), "submission_id", "timestamp")


def journal_to_json(spark, d):
    clicks = ops.with_tag(ops.with_status(records(spark, d), "success"), "click")
    # read back: numbers print differently in either engine
    array = F.from_json("history", T.ArrayType(ops.RECORD))
    rows = ops.to_json_array(clicks).select(F.posexplode(array).alias("place", "record"))
    return _shown(rows.select(F.col("place").cast("bigint").alias("place"), "record.*"))


def _messy(spark, d):
    """Records as the text a submitter types, some of it wrong."""
    e = table(spark, d, "events")
    n = F.col("event_id")
    words = F.element_at(F.array(*[F.lit(w) for w in ("true", "FALSE", "1", "no", "Yes", "0", "maybe")]), (n % 7 + 1).cast("int"))
    return e.select(
        F.lit(None).cast("string").alias("timestamp"),
        F.concat(F.lit("sub_"), "event_id").alias("submission_id"),
        words.alias("is_bug"),
        F.when(n % 19 == 0, F.lit("fast")).otherwise((n % 100).cast("string")).alias("metric"),
        F.when(n % 2 == 0, F.lit("yes")).otherwise(F.lit("no")).alias("lower_is_better"),
        F.col("event_type").alias("summary"),
        F.lit(None).cast("string").alias("parent_id"),
        F.when(n % 5 == 0, F.lit(None)).when(n % 23 == 0, F.lit('{"a": 1}')).otherwise(F.concat(F.lit('["'), "event_type", F.lit('"]'))).alias("tags"),
        F.when(n % 29 == 0, F.lit("../up")).otherwise(F.concat(F.lit("task_"), "user_id")).alias("task_id"),
    )


def journal_normalize(spark, d):
    good, bad = ops.normalize(_messy(spark, d))
    kept = _shown(good).select("submission_id", "is_bug", "metric", "lower_is_better", "tags", F.lit(None).cast("string").alias("problem"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("is_bug", "boolean"), ("metric", "double"), ("lower_is_better", "boolean"), ("tags", "string"))]
    return kept.unionByName(bad.select("submission_id", *empty, "problem"))


def journal_submit(spark, d):
    """Two submissions to one journal: the views first, then all events, some of them
    without a metric; each answer with the number of records stored in the end."""
    path = scratch_path(spark, "journal")
    raw = _messy(spark, d)
    number = F.regexp_extract("submission_id", r"(\d+)$", 1).cast("bigint")
    bare = raw.withColumn("metric", F.when(number % 31 != 0, F.col("metric")))
    answers = [
        submission.submit(part, path).withColumn("batch", F.lit(batch))
        for batch, part in (("first", raw.where(F.col("summary") == "view")), ("second", bare))
    ]
    stored = sinks.journal_load(spark, path).groupBy("task_id", "submission_id").agg(F.count(F.lit(1)).alias("n_stored"))
    told = reduce(DataFrame.unionByName, answers).withColumn("warnings", F.array_join("warnings", "; "))
    return told.join(stored, ["task_id", "submission_id"], "left")


def _repeated(spark, d):
    number = F.regexp_extract("submission_id", r"(\d+)$", 1).cast("bigint")
    return records(spark, d).withColumn("submission_id", F.concat(F.lit("sub_"), (number % 500).cast("string")))


def journal_duplicates(spark, d):
    return ops.duplicates(_repeated(spark, d))


def journal_already_stored(spark, d):
    # each record is on one of the sides
    stored = ops.with_status(_repeated(spark, d), "success")
    incoming = ops.with_status(_repeated(spark, d), "buggy")
    return ops.already_stored(incoming, stored).select("task_id", "submission_id", "timestamp")


def journal_missing_metric(spark, d):
    return ops.missing_metric(records(spark, d)).select("task_id", "submission_id")


def journal_best(spark, d):
    return ops.best(records(spark, d))


def journal_lineage(spark, d):
    linked = ops.lineage(_one_task(spark, d)).select("submission_id", "parent_id", "metric", "parent_metric", "change")
    return linked.withColumn("change", F.round("change", 4))


def journal_tree(spark, d):
    return ops.tree(_one_task(spark, d)).select("submission_id", "root", "depth")


def task_id_valid(spark, d):
    """Addresses, languages and path-like ids tried as task ids."""
    p = table(spark, d, "pages").select(F.col("url").alias("task_id"))
    c = table(spark, d, "customer").select(F.col("c_name").alias("task_id"))
    s = table(spark, d, "nation").select(F.concat(F.lower("n_name"), F.lit("_v-1")).alias("task_id"))
    everything = p.unionByName(c).unionByName(s)
    return everything.withColumn("is_valid", ops.valid_task_id(F.col("task_id")))


def task_partition(spark, d):
    n = F.col("event_id")
    resolved = ops.resolve_task(
        F.when(n % 3 == 0, F.concat(F.lit("own_"), n % 4)),
        F.when(n % 3 == 1, F.lit("ambient")),
        F.when(n % 2 == 0, F.substring(F.md5(F.col("event_type").cast("binary")), 1, 12)),
    )
    tasks = table(spark, d, "events").withColumn("task_id", resolved)
    return tasks.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))


def dataset_fingerprint(spark, d):
    return reduce(DataFrame.unionByName, [files.dataset_fingerprint(name, table(spark, d, name)) for name in ALL])


QUERIES = {
    "journal_load": journal_load,
    "journal_append": journal_append,
    "journal_markdown": journal_markdown,
    "history_status": history_status,
    "history_tag": history_tag,
    "history_topk": history_topk,
    "history_topk_per_task": history_topk_per_task,
    "journal_to_json": journal_to_json,
    "journal_normalize": journal_normalize,
    "journal_submit": journal_submit,
    "journal_duplicates": journal_duplicates,
    "journal_already_stored": journal_already_stored,
    "journal_missing_metric": journal_missing_metric,
    "journal_best": journal_best,
    "journal_lineage": journal_lineage,
    "journal_tree": journal_tree,
    "task_id_valid": task_id_valid,
    "task_partition": task_partition,
    "dataset_fingerprint": dataset_fingerprint,
}

# columns of the given tables: how many, and the first three
_SHAPES = {
    "region": (2, "r_regionkey_r_name"),
    "nation": (3, "n_nationkey_n_name_n_regionkey"),
    "customer": (5, "c_custkey_c_name_c_nationkey"),
    "supplier": (4, "s_suppkey_s_name_s_nationkey"),
    "part": (6, "p_partkey_p_name_p_brand"),
    "orders": (6, "o_orderkey_o_custkey_o_orderstatus"),
    "lineitem": (11, "l_orderkey_l_partkey_l_suppkey"),
    "events": (6, "event_id_ts_user_id"),
    "documents": (5, "doc_id_text_lang"),
    "embeddings": (3, "vec_id_embedding_label"),
    "pages": (3, "page_id_url_html"),
    "benchmark": (2, "item_id_text"),
    "labels": (3, "doc_id_quality_toxic"),
    "conversations": (4, "conv_id_turn_role"),
}
_SHOWN = f"select * replace (array_to_string(tags, ',') as tags) from ({_RECORDS})"
_REPEATED = f"""select * replace ('sub_' || (regexp_extract(submission_id, '(\\d+)$', 1)::bigint % 500) as submission_id)
    from ({_RECORDS})"""
_WORD = "(['true', 'FALSE', '1', 'no', 'Yes', '0', 'maybe'])[event_id % 7 + 1]"


def _md_line(label: str, expr: str) -> str:
    return f"'- **{label}**: ' || coalesce({expr}::varchar, 'None')"


SQL = {
    "journal_load": _SHOWN,
    "journal_append": _SHOWN,
    "journal_markdown": f"""select task_id, submission_id, concat_ws(chr(10), '## ' || submission_id,
        {_md_line('timestamp', 'timestamp')}, {_md_line('metric', 'floor(metric)::bigint')},
        {_md_line('lower_is_better', 'lower_is_better')}, {_md_line('is_bug', 'is_bug')}, {_md_line('summary', 'summary')},
        case when parent_id <> '' then {_md_line('parent_id', 'parent_id')} end,
        case when len(tags) > 0 then {_md_line('tags', "array_to_string(tags, ', ')")} end) as block from ({_RECORDS})""",
    "history_status": f"""select submission_id, case when coalesce(is_bug, true) then 'buggy' else 'success' end as status
        from ({_RECORDS})""",
    "history_tag": f"select task_id, submission_id, metric from ({_RECORDS}) where list_contains(tags, 'click')",
    "history_topk": f"""select timestamp, submission_id, task_id, metric from ({_RECORDS})
        order by timestamp desc, submission_id limit 20""",
    "history_topk_per_task": f"""select task_id, place, submission_id, timestamp from (select *,
        row_number() over (partition by task_id order by timestamp desc, submission_id) as place from ({_RECORDS}))
        where place <= 20""",
    "journal_to_json": f"""
        select row_number() over (order by timestamp desc, submission_id) - 1 as place,
               * replace (array_to_string(tags, ',') as tags)
        from ({_RECORDS}) where coalesce(is_bug, true) = false and list_contains(tags, 'click')
        order by timestamp desc, submission_id limit 20""",
    "journal_normalize": f"""
        with raw as (select *, lower({_WORD}) as word, case when event_id % 19 <> 0 then (event_id % 100)::double end as num
                     from events),
        judged as (select *, case when word = 'maybe' then 'is_bug is not a boolean'
            when num is null then 'metric is not a number'
            when event_id % 5 <> 0 and event_id % 23 = 0 then 'tags is not a JSON array'
            when event_id % 29 = 0 then 'task_id has other characters' end as problem,
            word in ('true', '1', 'yes') as bug from raw)
        select 'sub_' || event_id as submission_id, case when problem is null then bug end as is_bug,
               case when problem is null and not bug then num end as metric,
               case when problem is null then event_id % 2 = 0 end as lower_is_better,
               case when problem is null then (case when event_id % 5 = 0 then '' else event_type end) end as tags, problem
        from judged""",
    "journal_submit": f"""
        with raw as (select event_id, event_type, 'sub_' || event_id as submission_id, lower({_WORD}) as word,
                event_id % 19 <> 0 as number, event_id % 5 = 0 or event_id % 23 <> 0 as listed,
                case when event_id % 29 = 0 then '../up' else 'task_' || user_id end as task_id from events),
        parts as (select 'first' as batch, false as bare, * from raw where event_type = 'view'
                  union all select 'second', event_id % 31 = 0, * from raw),
        judged as (select *, case when word = 'maybe' then 'is_bug is not a boolean'
            when not number and not bare then 'metric is not a number'
            when not listed then 'tags is not a JSON array'
            when event_id % 29 = 0 then 'task_id has other characters' end as problem,
            word in ('true', '1', 'yes') as bug from parts),
        kept as (select task_id, submission_id, count(*) as n_stored from judged where problem is null group by all),
        early as (select distinct submission_id, true as again from judged where batch = 'first' and problem is null)
        select batch, case when problem is null then 'ok' else 'error' end as status, task_id, submission_id, problem,
            case when problem is not null then '' else concat_ws('; ',
                case when batch = 'second' and again
                    then 'submission_id ' || chr(39) || submission_id || chr(39) || ' is stored more than once' end,
                case when not bug and bare then 'a sound record has no metric' end) end as warnings, n_stored
        from judged left join kept using (task_id, submission_id) left join early using (submission_id)""",
    "journal_duplicates": f"""select task_id, submission_id, count(*) as records from ({_REPEATED}) group by 1, 2
        having count(*) > 1""",
    "journal_already_stored": f"""with j as ({_REPEATED}) select task_id, submission_id, timestamp from j
        where coalesce(is_bug, true) and (task_id, submission_id) in
          (select (task_id, submission_id) from j where not coalesce(is_bug, true))""",
    "journal_missing_metric": f"""select task_id, submission_id from ({_RECORDS})
        where not coalesce(is_bug, true) and metric is null""",
    "journal_best": f"""select task_id, lower_is_better,
        case when lower_is_better then min(metric) else max(metric) end as best_metric, count(*) as records
        from ({_RECORDS}) where not coalesce(is_bug, true) and metric is not null group by 1, 2""",
    "journal_lineage": f"""with j as ({_RECORDS}) select c.submission_id, c.parent_id, c.metric, p.metric as parent_metric,
        round(c.metric - p.metric, 4) as change from j c left join j p on c.parent_id = p.submission_id""",
    "journal_tree": f"""with recursive j as ({_RECORDS}), t as (
        select submission_id, submission_id as root, 0::bigint as depth from j where parent_id is null
        union all
        select j.submission_id, t.root, t.depth + 1 from j join t on j.parent_id = t.submission_id)
        select submission_id, root, depth from t""",
    "task_id_valid": """select task_id, regexp_full_match(task_id, '[A-Za-z0-9_-]+') as is_valid from (
        select url as task_id from pages union all select c_name from customer
        union all select lower(n_name) || '_v-1' from nation)""",
    "task_partition": """select task_id, count(*) as n from (select coalesce(
        case when event_id % 3 = 0 then 'own_' || (event_id % 4) end, case when event_id % 3 = 1 then 'ambient' end,
        'task_' || case when event_id % 2 = 0 then substr(md5(event_type), 1, 12) end, 'default_task') as task_id
        from events) group by 1""",
    "dataset_fingerprint": union_sql(
        [
            f"""select '{name}' as dataset, count(*) as n_rows,
                substr(md5('{n}_{names}_' || count(*)), 1, 12) as fingerprint from {name}"""
            for name, (n, names) in _SHAPES.items()
        ]
    ),
}
