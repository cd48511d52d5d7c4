"""A corpus pipeline of five of the operators: what each stage keeps is the next one's input.

Rows are told apart by doc_id and text, either of which may be null. No stage but the
second drops repeated rows, and none fails on an empty table, an empty or very long text,
or columns beside those of ``documents``, which all stages but the last hand on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import bpe, decontaminate, quality_classifier, secret_scan, simhash
from gristmill.llm.storage import written

KEY = ["__doc", "__body"]


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key that tells rows of equal or null doc_id apart by their text; a
    null text counts as empty."""
    return docs.withColumns({"__doc": F.col("doc_id"), "__body": F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))})


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["__doc"].eqNullSafe(b["__doc"]) & (a["__body"] == b["__body"])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labelled ones, does not reject: those
    with a score of 0.3 or more. A null text is scored as an empty one. Without labels of
    both kinds nothing is rejected."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    scored = quality_classifier.score(docs, model)
    return scored.where(F.col("__score") >= 0.3).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, of repeated rows
    the first. Rows without doc_id stay only where their group has no other."""
    found = simhash.near_duplicates(_keyed(docs).select(*KEY, "text"), KEY, order="__doc")
    first = F.min(F.struct(F.col("__doc").isNull(), *KEY)).alias("first")
    kept = written(found.groupBy("root").agg(first).select("first.__doc", "first.__body"), "kept")
    keyed = _keyed(docs)
    once = keyed.join(kept, _same(keyed, kept), "left_semi").dropDuplicates(KEY)
    return once.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; those without a text contain none. Of
    repeated rows all go or all stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = _keyed(docs)
    found = decontaminate.contained_items(keyed.select(*KEY, "text"), items, KEY).select(*KEY).distinct()
    return keyed.join(found, _same(keyed, found), "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each secret, or group of overlapping ones, replaced and, in
    such documents, ``n_chars`` counted anew. Texts without a secret stay as they are,
    null ones null."""
    scanned = secret_scan.scan(docs)
    text = secret_scan.redacted("text", "__secrets.spans")
    changed = scanned.withColumn("text", text)
    if "n_chars" in docs.columns:
        n = F.when(F.size("__secrets.spans") > 0, F.length("text")).otherwise(F.col("n_chars"))
        changed = changed.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the digests of the encoded and decoded text, a row for each row; a null
    text is encoded as an empty one."""
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return bpe.encode(docs, vocabulary, ["doc_id"])


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secrets),
    ("tokens", tokens),
]
#: The classifier and the tokenizer have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
