"""Writing and reading back profiles, feature tables and the journal."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.hashing import bucket_of
from gristmill.operators import journal as journal_ops

NUM, CAT, TOP, CROSS, MEDIANS = "num_features", "cat_features", "cat_top_values", "cross_cat_features", "group_medians"
ENCODING, FILLS, STATS, EMBEDDINGS = "encoding_map", "fill_na_map", "numerical_stats", "embedding_dims"

# Schemas of the written lines.
_NUM = (
    "feature string, nunique bigint, null_count bigint, null_ratio double, zero_count bigint, zero_ratio double, "
    "mean double, median double, std double, min double, max double, "
    "P1 double, P10 double, P25 double, P50 double, P75 double, P90 double, P99 double"
)
_CAT = (
    "feature string, nunique bigint, null_count bigint, null_ratio double, skipped boolean, coverage double, "
    "items_kept bigint"
)
_TOP = "feature string, value string, rank bigint, count bigint, ratio double"
_CROSS = "pair string, a string, b string, rank bigint, count bigint, ratio double"
_MEDIANS = "feature string, `group` string, median double"


#: The maps made from a profile, by file name.
MAPS = {
    ENCODING: "feature string, value string, id bigint",
    FILLS: "feature string, kind string, fill_value string",
    STATS: "feature string, mean double, std double",
    EMBEDDINGS: "feature string, nunique bigint, embedding_dim bigint",
}


def write_profile_json(
    directory: str,
    num: DataFrame | None = None,
    cat: tuple[DataFrame, DataFrame] | None = None,
    cross: DataFrame | None = None,
    medians: DataFrame | None = None,
) -> None:
    """JSON lines: one per numeric feature, per categorical feature, per kept value,
    per kept value pair, and per feature and group. Whatever grows with the data is
    a line of its own, never folded into one document."""
    summary, top = cat or (None, None)
    for name, part in ((NUM, num), (CAT, summary), (TOP, top), (CROSS, cross), (MEDIANS, medians)):
        if part is not None:
            _write_lines(part, f"{directory}/{name}")


def _write_lines(part: DataFrame, path: str) -> None:
    part.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The written lines; none were written: an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_profile(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The written profile; a part that was not written is an empty table."""
    parts = {"num": (NUM, _NUM), "cat": (CAT, _CAT), "top": (TOP, _TOP), "cross": (CROSS, _CROSS), "medians": (MEDIANS, _MEDIANS)}
    return {name: _read_lines(spark, f"{directory}/{file}", schema) for name, (file, schema) in parts.items()}


def write_maps(directory: str, **maps: DataFrame) -> None:
    """The maps named in ``MAPS`` as JSON lines, one per entry."""
    for name, table in maps.items():
        columns = [c.split(" ")[0] for c in MAPS[name].split(", ")]
        _write_lines(table.select(*columns), f"{directory}/{name}")


def read_maps(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The written maps; one that was not written is an empty table."""
    return {name: _read_lines(spark, f"{directory}/{name}", schema) for name, schema in MAPS.items()}


def write_csv(table: DataFrame, path: str) -> None:
    """A CSV directory with a header. Blanks at either end of a text and line breaks in
    it are kept; an empty text is written as ``""``, a null as nothing."""
    writer = table.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", '""')
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.csv(path)


def write_features_csv(train: DataFrame, test: DataFrame, directory: str) -> None:
    """Engineered tables as CSV directories."""
    for name, table in (("train_engineered", train), ("test_engineered", test)):
        write_csv(table, f"{directory}/{name}")


#: A journal keeps its tasks in so many folders, by a stable bucket of the task.
TASK_FOLDER, TASK_FOLDERS = "task_folder", 64


def _by(table: DataFrame, folder: str) -> DataFrame:
    """Rows of a folder lie together, so that a folder gets few files; rebalancing,
    unlike a plain repartition, splits a folder that holds most of the rows."""
    return table.hint("rebalance", folder)


def journal_append(records: DataFrame, directory: str) -> None:
    """Add records below their task's folder; earlier files are never rewritten.

    A folder holds all tasks of a bucket, and the task stands in the line: the number of
    files grows with the bytes written, not with the number of tasks."""
    task = F.nullif(F.col("task_id").cast("string"), F.lit(""))
    dealt = records.withColumn("task_id", task).withColumn(TASK_FOLDER, bucket_of(F.col("task_id"), TASK_FOLDERS))
    _by(dealt, TASK_FOLDER).write.mode("append").partitionBy(TASK_FOLDER).json(directory)


def _lines_below(spark: SparkSession, directory: str, folder: str) -> DataFrame | None:
    """The lines in the folders ``folder=...``, read as text; None if there are no such folders."""
    reader = spark.read.schema(f"value string, {folder} string").option("basePath", directory)
    try:
        return reader.text(f"{directory.rstrip('/')}/{folder}=*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def journal_load(spark: SparkSession, directory: str, task: str | None = None) -> DataFrame:
    """The whole journal, or the records of ``task``, for which one folder is read; a missing
    folder is an empty journal. Blank and malformed lines are skipped.

    Journals with a folder ``task_id=...`` per task are read as well, also where folders of
    buckets were added to them; the task comes from the folder name then, as text."""
    single, dealt = (_lines_below(spark, directory, folder) for folder in ("task_id", TASK_FOLDER))
    fields = [f.name for f in journal_ops.RECORD if f.name != "task_id"]
    parts = []
    if single is not None:
        parsed = journal_ops.parse_lines(single.withColumnRenamed("task_id", "folder"), keep=["folder"])
        parts.append(parsed.select(*fields, F.coalesce("task_id", "folder").alias("task_id")))
    if dealt is not None:
        if task is not None:
            dealt = dealt.where(F.col(TASK_FOLDER) == bucket_of(F.lit(task), TASK_FOLDERS).cast("string"))
        parts.append(journal_ops.parse_lines(dealt))
    if not parts:
        try:
            parts = [journal_ops.parse_lines(spark.read.text(directory))]
        except AnalysisException:
            parts = [spark.createDataFrame([], journal_ops.RECORD)]
    whole = reduce(DataFrame.unionByName, parts)
    return whole if task is None else whole.where(F.col("task_id") == task)


def write_journal_markdown(journal: DataFrame, directory: str) -> None:
    """Readable blocks as text, one folder per task."""
    blocks = journal_ops.markdown(journal).select("task_id", F.concat(F.lit("\n"), "block").alias("value"))
    _by(blocks, "task_id").write.mode("append").partitionBy("task_id").text(directory)
