"""Experiment journal: an append-only table partitioned by task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.operators.lookup import settled

# The record's fields, accepted words for booleans, the task id
# pattern and the fallback task.
RECORD = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("submission_id", T.StringType()),
        T.StructField("is_bug", T.BooleanType()),
        T.StructField("metric", T.DoubleType()),
        T.StructField("lower_is_better", T.BooleanType()),
        T.StructField("summary", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("task_id", T.StringType()),
    ]
)
TRUE_WORDS = ["true", "1", "yes"]
FALSE_WORDS = ["false", "0", "no"]
TASK_ID_PATTERN = r"^[A-Za-z0-9_-]+\z"
DEFAULT_TASK = "default_task"
STATUSES = ("all", "success", "buggy")


def parse_lines(lines: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Records from JSON lines; blank and malformed lines are dropped.

    A line counts as a record when it parses as a JSON object, even without an
    id. ``keep`` names columns to carry along.
    """
    return (
        lines.withColumn("_line", F.trim(F.col(column)))
        .where(F.col("_line").startswith("{") & F.try_parse_json("_line").isNotNull())
        .select(F.from_json("_line", RECORD).alias("_r"), *keep)
        .select("_r.*", *keep)
    )


def to_boolean(text: Column) -> Column:
    low = F.lower(text.cast("string"))
    return F.when(low.isin(*TRUE_WORDS), F.lit(True)).when(low.isin(*FALSE_WORDS), F.lit(False))


def valid_task_id(task_id: Column) -> Column:
    return F.coalesce(task_id.rlike(TASK_ID_PATTERN), F.lit(False))


def resolve_task(explicit: Column, environment: Column, fingerprint: Column) -> Column:
    """Explicit id, else the environment's, else the data's fingerprint, else the default."""
    given = F.when(explicit != "", explicit)
    ambient = F.when(environment != "", environment)
    return F.coalesce(given, ambient, F.concat(F.lit("task_"), fingerprint), F.lit(DEFAULT_TASK))


def normalize(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(records, rejects)`` from text columns.

    Booleans accept the usual words, a bug keeps no metric, tags must be a JSON
    array (absent means none). Rows that break a rule go to ``rejects`` with a
    ``problem`` column.
    """
    tags = F.coalesce(F.when(F.trim("tags") != "", F.col("tags")), F.lit("[]"))
    checked = (
        raw.withColumn("_bug", to_boolean(F.col("is_bug")))
        .withColumn("_low", to_boolean(F.col("lower_is_better")))
        .withColumn("_json", F.try_parse_json(tags))
        .withColumn("_number", F.col("metric").try_cast("double"))
        .withColumn(
            "problem",
            F.when(F.col("submission_id").isNull(), F.lit("submission_id is missing"))
            .when(F.col("_bug").isNull(), F.lit("is_bug is not a boolean"))
            .when(F.col("_low").isNull(), F.lit("lower_is_better is not a boolean"))
            .when(F.col("summary").isNull(), F.lit("summary is missing"))
            .when(F.col("metric").isNotNull() & F.col("_number").isNull(), F.lit("metric is not a number"))
            .when(~F.coalesce(F.schema_of_variant("_json").startswith("ARRAY"), F.lit(False)), F.lit("tags is not a JSON array"))
            .when(~valid_task_id(F.col("task_id")), F.lit("task_id has other characters")),
        )
    )
    records = checked.where(F.col("problem").isNull()).select(
        "timestamp",
        "submission_id",
        F.col("_bug").alias("is_bug"),
        F.when(~F.col("_bug"), F.col("_number")).alias("metric"),
        F.col("_low").alias("lower_is_better"),
        "summary",
        "parent_id",
        F.from_json(tags, "array<string>").alias("tags"),
        "task_id",
    )
    rejects = checked.where(F.col("problem").isNotNull()).drop("_bug", "_low", "_json", "_number")
    return records, rejects


def with_status(journal: DataFrame, status: str = "all") -> DataFrame:
    """``success`` or ``buggy`` records; one without a verdict counts as buggy."""
    if status not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}")
    bug = F.coalesce("is_bug", F.lit(True))
    return {"all": journal, "success": journal.where(~bug), "buggy": journal.where(bug)}[status]


def with_tag(journal: DataFrame, tag: str) -> DataFrame:
    """Records carrying exactly this tag; missing tags mean none."""
    return journal.where(F.coalesce(F.array_contains("tags", F.lit(tag)), F.lit(False)))


def _newest_first() -> list[Column]:
    return [F.coalesce("timestamp", F.lit("")).desc(), F.col("submission_id").asc()]


def latest(journal: DataFrame, limit: int = 20) -> DataFrame:
    """Newest records first; each task keeps at most ``limit`` rows on its way."""
    return journal.orderBy(*_newest_first()).limit(limit)


def latest_per_task(journal: DataFrame, limit: int = 20) -> DataFrame:
    """The newest ``limit`` records of every task, with their ``place``.

    The rank limit runs before the shuffle too, so a task with a third of all
    records sends at most ``limit`` rows per partition.
    """
    newest = Window.partitionBy("task_id").orderBy(*_newest_first())
    return journal.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= limit)


def to_json_array(history: DataFrame, limit: int = 20) -> DataFrame:
    """One compact JSON array of the newest ``limit`` records, newest first."""
    placed = latest(history, limit).withColumn("_place", F.row_number().over(Window.orderBy(*_newest_first())))
    ordered = F.array_sort(F.array_agg(F.struct("_place", F.struct(*history.columns).alias("record"))))
    return placed.agg(F.to_json(F.transform(ordered, lambda e: e["record"])).alias("history"))


def duplicates(journal: DataFrame) -> DataFrame:
    """``(task_id, submission_id, records)`` for ids stored more than once."""
    return (
        journal.groupBy("task_id", "submission_id")
        .agg(F.count(F.lit(1)).alias("records"))
        .where(F.col("records") > 1)
    )


def already_stored(incoming: DataFrame, journal: DataFrame) -> DataFrame:
    """Incoming records whose id the task already has; they are flagged, not refused.

    The stored ids are made distinct before the join, so repeats on either side
    cannot multiply.
    """
    known = journal.select("task_id", "submission_id").distinct()
    return incoming.join(known, ["task_id", "submission_id"], "left_semi")


def warnings(records: DataFrame, stored: DataFrame) -> DataFrame:
    """``records`` with ``warnings``: texts on an id that the task holds already, or that
    comes more than once among the records, and on a sound record without a metric.

    Ids are made distinct on either side before the join; whoever has none of the two
    faults has an empty array."""
    keys = ["task_id", "submission_id"]
    repeated = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*keys)
    known = stored.select(*keys).unionByName(repeated).distinct().withColumn("_again", F.lit(True))
    again = F.when(F.col("_again"), F.concat(F.lit("submission_id '"), "submission_id", F.lit("' is stored more than once")))
    bare = F.when(~F.col("is_bug") & F.col("metric").isNull(), F.lit("a sound record has no metric"))
    return records.join(known, keys, "left").withColumn("warnings", F.array_compact(F.array(again, bare))).drop("_again")


def missing_metric(journal: DataFrame) -> DataFrame:
    """Sound records that carry no metric and so cannot be compared."""
    return journal.where(~F.coalesce("is_bug", F.lit(True)) & F.col("metric").isNull())


def best(journal: DataFrame) -> DataFrame:
    """``(task_id, lower_is_better, best_metric, records)`` over sound records.

    Direction belongs to the record, so a task that mixes both has two rows.
    """
    return (
        with_status(journal, "success")
        .where(F.col("metric").isNotNull())
        .groupBy("task_id", "lower_is_better")
        .agg(F.min("metric").alias("_low"), F.max("metric").alias("_high"), F.count(F.lit(1)).alias("records"))
        .select(
            "task_id",
            "lower_is_better",
            F.when(F.col("lower_is_better"), F.col("_low")).otherwise(F.col("_high")).alias("best_metric"),
            "records",
        )
    )


def _last_record(journal: DataFrame) -> DataFrame:
    """One row per id: stored duplicates must not multiply a join."""
    return journal.groupBy("task_id", "submission_id").agg(
        F.max(F.struct(F.coalesce("timestamp", F.lit("")).alias("t"), "metric", "parent_id")).alias("last")
    )


def lineage(journal: DataFrame) -> DataFrame:
    """Every record with its parent's metric and the change from it.

    Records without a parent take no part in the join: they would all share the
    null key. A popular parent is one row on its side; the partition of its
    children is split by adaptive execution.
    """
    columns = ["task_id", "submission_id", "parent_id", "metric"]
    parents = _last_record(journal).select(
        "task_id", F.col("submission_id").alias("parent_id"), F.col("last.metric").alias("parent_metric")
    )
    children = journal.where(F.col("parent_id").isNotNull()).select(*columns)
    linked = children.join(parents, ["task_id", "parent_id"], "left").select(*columns, "parent_metric")
    roots = journal.where(F.col("parent_id").isNull()).select(
        *columns, F.lit(None).cast("double").alias("parent_metric")
    )
    return linked.unionByName(roots).withColumn("change", F.col("metric") - F.col("parent_metric"))


def tree(journal: DataFrame) -> DataFrame:
    """``(task_id, submission_id, root, depth)`` of every id, by pointer doubling.

    Each round lets every unfinished id jump to its pointer's pointer, so a
    chain of a million ids takes twenty rounds instead of a million. A round is
    one join on ``(task_id, id)`` whose result, the open and the newly finished ids
    alone, is written to the shared folder, which keeps the plan short and survives
    lost executors. Finished ids leave the loop and are not written again, so the
    roots do not turn into hot keys. An id whose parent is not
    stored is a root; ids on or below a cycle get null root and depth.
    """
    nodes = _last_record(journal).select("task_id", F.col("submission_id").alias("id"), F.col("last.parent_id").alias("up"))
    nodes = settled(nodes)
    present = nodes.select("task_id", F.col("id").alias("up"), F.lit(True).alias("_known"))
    linked = nodes.where(F.col("up").isNotNull()).join(present, ["task_id", "up"], "left")
    top = nodes.where(F.col("up").isNull()).select("task_id", "id", F.col("id").alias("root"), F.lit(0).cast("bigint").alias("steps"))
    # of an open id, `up` is an ancestor `steps` above
    start = settled(linked.select("task_id", "id", "up", "_known", F.lit(1).cast("bigint").alias("steps")))
    finished = [top, start.where(F.col("_known").isNull()).select("task_id", "id", F.col("id").alias("root"), F.lit(0).cast("bigint").alias("steps"))]
    going = start.where(F.col("_known")).select("task_id", "id", "up", "steps")
    longest, reach = nodes.count(), 1
    while not going.isEmpty() and reach <= 2 * longest:
        ends = reduce(DataFrame.unionByName, finished).select(
            "task_id", F.col("id").alias("up"), F.lit(None).cast("string").alias("_up"), F.col("root").alias("_root"), F.col("steps").alias("_steps")
        )
        ways = going.select(
            "task_id", F.col("id").alias("up"), F.col("up").alias("_up"), F.lit(None).cast("string").alias("_root"), F.col("steps").alias("_steps")
        )
        moved = settled(
            going.join(ends.unionByName(ways), ["task_id", "up"]).select(
                "task_id", "id", F.col("_up").alias("up"), F.col("_root").alias("root"), (F.col("steps") + F.col("_steps")).alias("steps")
            )
        )
        finished.append(moved.where(F.col("root").isNotNull()).select("task_id", "id", "root", "steps"))
        going = moved.where(F.col("root").isNull()).select("task_id", "id", "up", "steps")
        reach *= 2
    lost = going.select("task_id", "id", F.lit(None).cast("string").alias("root"), F.lit(None).cast("bigint").alias("steps"))
    done = reduce(DataFrame.unionByName, [*finished, lost])
    return done.select("task_id", F.col("id").alias("submission_id"), "root", F.col("steps").alias("depth"))


def markdown(journal: DataFrame) -> DataFrame:
    """``(task_id, submission_id, block)``: a readable block per record. Parent
    and tags have a line only when there is something to show."""

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"- **{label}**: "), F.coalesce(value.cast("string"), F.lit("None")))

    block = F.concat_ws(
        "\n",
        F.concat(F.lit("## "), F.col("submission_id")),
        line("timestamp", F.col("timestamp")),
        line("metric", F.col("metric")),
        line("lower_is_better", F.col("lower_is_better")),
        line("is_bug", F.col("is_bug")),
        line("summary", F.col("summary")),
        F.when(F.col("parent_id") != "", line("parent_id", F.col("parent_id"))),
        F.when(F.size("tags") > 0, line("tags", F.array_join("tags", ", "))),
    )
    return journal.select("task_id", "submission_id", block.alias("block"))
