"""Reading directories of Parquet and CSV files."""

from __future__ import annotations

import csv
import random
import re
from collections.abc import Sequence
from fnmatch import fnmatchcase
from functools import reduce
from posixpath import normpath
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.hashing import bucket_of
from gristmill.functions.roles import quoted

FILE_TYPES = ("parquet", "csv")

#: A profile scan reads only empty fields as missing: without quotes they always are, with
#: quotes where the words say so.
EMPTY_ONLY = [""]
QUOTED_EMPTY = "\u0001"
# Words that mean "missing" in the tables of a feature job.
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def _checked(file_type: str) -> str:
    name = file_type.lower()
    if name not in FILE_TYPES:
        raise ValueError(f"unsupported file type {file_type!r}: expected one of {FILE_TYPES}")
    return name


def _listed(spark: SparkSession, directory: str, pattern: str, recursive: bool) -> list[str]:
    reader = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern)
    # a listing only: the schema is given, so no file is opened
    return reader.schema("value string").text(directory).inputFiles()


def _matches(name: str, pattern: str) -> bool:
    """Whether the glob ``pattern`` of a scan, which may hold ``{a,b}``, names ``name``."""
    either = re.search(r"\{([^{}]*)\}", pattern)
    if either:
        head, tail = pattern[: either.start()], pattern[either.end() :]
        return any(_matches(name, head + part + tail) for part in either[1].split(","))
    return fnmatchcase(name, pattern.replace("[^", "[!"))


def _tables(spark: SparkSession, directory: str, pattern: str, file_type: str) -> dict[str, list[str]]:
    """The topmost folders ``*.<type>`` below ``directory`` that ``pattern`` names, and the
    listed files of the type in each: a table that Spark wrote is a folder of part files,
    whose own names the pattern does not know."""
    ending = f"*.{file_type}"
    if pattern == ending:
        return {}  # every file below is found by its own name
    top = normpath("/" + re.sub(r"^[\w.+-]+:/*", "", directory).strip("/"))
    found: dict[str, list[str]] = {}
    for file in _listed(spark, directory, ending, True):
        head, _, below = unquote(file).partition(f"{top}/")
        names = below.split("/")[:-1]
        depth = next((i for i, n in enumerate(names, 1) if fnmatchcase(n, ending) and _matches(n, pattern)), 0)
        if depth:
            found.setdefault("/".join([f"{head}{top}", *names[:depth]]), []).append(file)
    return found


def list_files(
    spark: SparkSession, directory: str, file_type: str = "parquet", pattern: str | None = None, recursive: bool = True
) -> list[str]:
    """Sorted paths of the matching files; an empty listing is an error. Where
    ``recursive``, a folder ``*.<type>`` that ``pattern`` names stands for the files of the
    type in it."""
    name = _checked(file_type)
    pattern = pattern or f"*.{name}"
    try:
        found = set(_listed(spark, directory, pattern, recursive))
        tables = _tables(spark, directory, pattern, name) if recursive else {}
    except AnalysisException as error:
        raise FileNotFoundError(f"{directory}: nothing there that {pattern} names ({name})") from error
    found = sorted(found.union(*tables.values()))
    if not found:
        raise FileNotFoundError(f"{directory}: nothing there that {pattern} names ({name})")
    return found


def resolve_file_type(
    spark: SparkSession, directory: str, explicit: str | None = None, configured: str | None = None
) -> str:
    """Explicit, else configured, else CSV only where there is CSV and no Parquet."""
    if explicit or configured:
        return _checked(explicit or configured)
    try:
        list_files(spark, directory, "parquet")
        return "parquet"
    except FileNotFoundError:
        pass
    try:
        list_files(spark, directory, "csv")
        return "csv"
    except FileNotFoundError:
        return "parquet"


def scan_parquet(
    spark: SparkSession,
    source: str | Sequence[str],
    columns: Sequence[str] | None = None,
    pattern: str = "*.parquet",
    recursive: bool = True,
    same_schema: bool = True,
) -> DataFrame:
    """A directory (searched below, unless ``recursive`` is off) or a list of
    files as one table. Only ``columns`` are read when given. In the search, a
    folder ``*.parquet`` that ``pattern`` names stands for all ``*.parquet`` files in it.

    With ``same_schema`` tasks read all footers and merge them: files whose types
    disagree, or that have columns which the table's schema lacks, are an error. A file
    that lacks a column of the table is read with nulls there.
    """
    paths, names = [source] if isinstance(source, str) else list(source), pattern
    try:
        tables = _tables(spark, source, pattern, "parquet") if isinstance(source, str) and recursive else {}
        if tables:
            files = [unquote(f) for f in _listed(spark, source, pattern, True)]
            paths = [*tables, *[f for f in files if not f.startswith(tuple(f"{t}/" for t in tables))]]
            paths = [re.sub(r"([][{}*?\\])", r"\\\1", p) for p in paths]  # as they are, not as globs
            names = f"{{{pattern},*.parquet}}"
        reader = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", names)
        table = reader.parquet(*paths)
    except AnalysisException as error:
        raise FileNotFoundError(f"{source}: nothing there that {pattern} names (parquet)") from error
    if same_schema:
        try:
            merged = reader.option("mergeSchema", True).parquet(*paths).schema
        except (Py4JJavaError, PySparkException) as error:
            if "MERGE_SCHEMA" not in str(error):
                raise
            raise ValueError(f"{source}: the files disagree on the type of a column") from error
        own, every = ({(f.name, f.dataType.simpleString()) for f in schema} for schema in (table.schema, merged))
        if own != every:
            raise ValueError(f"{source}: some files have other columns: {sorted(own ^ every)}")
    return table.select(*[quoted(c) for c in columns]) if columns else table


def _headers(spark: SparkSession, files: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Column names, in the order of the file, and the files that have them so.

    A file's header is its first line. Tasks find it; a line per file reaches the
    driver, which holds the list of files anyway.
    """
    lines = spark.read.text(list(files)).select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"),
        "value",
    )
    first = lines.groupBy("path").agg(F.min_by("value", "at").alias("line"))
    listed = first.agg(F.sort_array(F.collect_list(F.struct("path", "line"))).alias("files")).first()["files"]
    found: dict[tuple[str, ...], list[str]] = {}
    for path, line in listed:
        names = tuple(next(csv.reader([line.removeprefix("\ufeff").rstrip("\r")])))
        found.setdefault(names, []).append(path)
    return found


def read_csv_text(spark: SparkSession, files: Sequence[str], multi_line: bool = True) -> DataFrame:
    """The fields of CSV files as text, and ``_file``. Each file's columns are told by
    its own header, so their order may differ; other columns than the first file's are
    an error that names the files. With ``multi_line`` quoted fields may hold line
    breaks, and a file is read by one task; without, large files are split."""
    headers = _headers(spark, files)
    if not headers:
        raise FileNotFoundError(f"no line in {list(files)[:3]}")
    columns = next(names for names, paths in headers.items() if min(min(p) for p in headers.values()) in paths)
    if len(set(columns)) < len(columns):
        raise ValueError(f"columns named twice: {columns}")
    other = {paths[0]: names for names, paths in headers.items() if sorted(names) != sorted(columns)}
    if other:
        raise ValueError(f"files of one table have other columns than {list(columns)}: {other}")
    parts = []
    for names, paths in headers.items():
        texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
        reader = spark.read.schema(texts).option("header", True).option("escape", '"').option("multiLine", multi_line)
        table = reader.option("enforceSchema", True).option("emptyValue", QUOTED_EMPTY).csv(paths)
        cells = [F.when(F.col(quoted(c)) == QUOTED_EMPTY, "").otherwise(F.col(quoted(c))).alias(c) for c in columns]
        parts.append(table.select(*cells, F.col("_metadata.file_path").alias("_file")))
    return reduce(DataFrame.unionByName, parts)


def _present(text: Column, missing: Sequence[str]) -> Column:
    return F.when(~text.isin(*missing), text)


def infer_csv_schema(texts: DataFrame, missing: Sequence[str] = EMPTY_ONLY) -> T.StructType:
    """Column types from all rows of ``read_csv_text``.

    The narrowest of whole number, double and boolean that fits every present value;
    text otherwise, and for columns without one. One aggregation of three flags per
    column, which combine over rows, files and tasks.
    """
    columns = [c for c in texts.columns if c != "_file"]
    fits = {
        "bigint": lambda c: c.try_cast("bigint").isNotNull(),
        "double": lambda c: c.try_cast("double").isNotNull(),
        "boolean": lambda c: F.lower(c).isin("true", "false"),
    }
    checks = [F.lit(True)]
    for i, name in enumerate(columns):
        value = _present(F.col(quoted(name)), missing)
        checks += [F.bool_and(F.when(value.isNotNull(), test(value))).alias(f"{kind}{i}") for kind, test in fits.items()]
    seen = texts.agg(*checks).first()
    types = {"bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    fields = []
    for i, name in enumerate(columns):
        kind = next((types[k] for k in fits if seen[f"{k}{i}"]), T.StringType())
        fields.append(T.StructField(name, kind))
    return T.StructType(fields)


def _csv_files(spark: SparkSession, source: str | Sequence[str], recursive: bool) -> list[str]:
    return list_files(spark, source, "csv", recursive=recursive) if isinstance(source, str) else list(source)


def scan_csv(
    spark: SparkSession,
    source: str | Sequence[str],
    schema: T.StructType | None = None,
    columns: Sequence[str] | None = None,
    recursive: bool = True,
    missing: Sequence[str] = EMPTY_ONLY,
    multi_line: bool = True,
) -> DataFrame:
    """CSV files with a header as one table under one schema, by default the narrowest
    that fits all rows of all files.

    Fields are read as text, ``missing`` words become null, then each column is cast.
    A value that does not fit a given ``schema`` becomes null; ``csv_misfits`` lists them.
    """
    texts = read_csv_text(spark, _csv_files(spark, source, recursive), multi_line)
    schema = schema or infer_csv_schema(texts, missing)
    fields = [f for f in schema if columns is None or f.name in columns]
    return texts.select(*[_present(F.col(quoted(f.name)), missing).try_cast(f.dataType).alias(f.name) for f in fields])


def csv_misfits(
    spark: SparkSession,
    source: str | Sequence[str],
    schema: T.StructType,
    recursive: bool = True,
    missing: Sequence[str] = EMPTY_ONLY,
    multi_line: bool = True,
) -> DataFrame:
    """``(file, column, value)``: the present values that do not fit ``schema``."""
    texts = read_csv_text(spark, _csv_files(spark, source, recursive), multi_line)
    cells = []
    for field in schema:
        value = _present(F.col(quoted(field.name)), missing)
        bad = value.isNotNull() & value.try_cast(field.dataType).isNull()
        cells.append(F.when(bad, F.struct(F.lit(field.name).alias("column"), value.alias("value"))))
    return texts.select(F.col("_file").alias("file"), F.inline(F.array_compact(F.array(*cells))))


def sample_files(files: Sequence[str], ratio: float, seed: int = 42) -> list[str]:
    """A repeatable choice of ``max(1, int(n * ratio))`` files, sorted."""
    if not 0 < ratio <= 1:
        raise ValueError(f"ratio must be in (0, 1], got {ratio}")
    if ratio >= 1 or not files:
        return list(files)
    return sorted(random.Random(seed).sample(list(files), max(1, int(len(files) * ratio))))


def sample_rows(df: DataFrame, key: str, ratio: float) -> DataFrame:
    """A repeatable share of the rows by a stable hash of ``key``, to 1/10,000."""
    if not 0 < ratio <= 1:
        raise ValueError(f"ratio must be in (0, 1], got {ratio}")
    return df.where(bucket_of(F.col(quoted(key)), 10_000) < round(ratio * 10_000))


def dataset_fingerprint(name: str, table: DataFrame) -> DataFrame:
    """``(dataset, n_rows, fingerprint)``: a short stable id from the number of columns,
    the first three names and the number of rows of a table."""
    head = "_".join([str(len(table.columns)), *table.columns[:3]])
    counted = table.agg(F.count(F.lit(1)).alias("n_rows"))
    text = F.concat_ws("_", F.lit(head), "n_rows")
    return counted.select(F.lit(name).alias("dataset"), "n_rows", F.substring(F.md5(text.cast("binary")), 1, 12).alias("fingerprint"))
