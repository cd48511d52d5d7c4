"""Integrity checks over tables of pages and records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Link prefixes that never point into the site, and how a link is
# written in Markdown and in HTML.
EXTERNAL_PREFIXES = ["http://", "https://", "mailto:", "ftp://", "tel:"]
LINK_PATTERNS = [r"\[[^\]]*\]\(([^)]+)\)", r'href="([^"]*)"']


def url_path(url: Column) -> Column:
    """Path of an address: no scheme, host, query or anchor."""
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def _tidy(path: Column) -> Column:
    """Collapse ``//`` and ``/./`` and drop a trailing slash."""
    flat = F.regexp_replace(F.regexp_replace(path, r"/(\./)+", "/"), r"/+", "/")
    return F.when(flat == "/", flat).otherwise(F.regexp_replace(flat, r"/$", ""))


def links(pages: DataFrame) -> DataFrame:
    """``(page_id, link, occurrences, folder, target)`` of internal links.

    External schemes, bare anchors and empty links are left out; anchors and
    queries are cut off. Repeats within a page collapse here, before any join.
    """
    found = F.flatten(F.array(*[F.regexp_extract_all("html", F.lit(p), F.lit(1)) for p in LINK_PATTERNS]))
    raw = pages.select(
        "page_id", F.regexp_replace(url_path(F.col("url")), r"[^/]*$", "").alias("folder"), F.explode(found).alias("link")
    )
    target = F.regexp_replace(F.trim("link"), r"[#?].*$", "")
    outside = F.lit(False)
    for prefix in EXTERNAL_PREFIXES:
        outside = outside | F.startswith(F.trim("link"), F.lit(prefix))
    return (
        raw.withColumn("target", target)
        .where(~outside & (F.col("target") != ""))
        .groupBy("page_id", "folder", "link", "target")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def broken_links(pages: DataFrame) -> DataFrame:
    """``(page_id, link, occurrences)`` of links that lead to no known page.

    A rooted link has one candidate, a relative one is tried below its own
    folder and below the root. Known paths are distinct, so the join never
    multiplies links; the partition of a path that every page links to is split
    by adaptive execution.
    """
    rooted = F.startswith("target", F.lit("/"))
    candidates = links(pages).withColumn(
        "paths",
        F.when(rooted, F.array(_tidy(F.col("target")))).otherwise(
            F.array(
                _tidy(F.concat(F.when(F.col("folder") == "", F.lit("/")).otherwise(F.col("folder")), F.col("target"))),
                _tidy(F.concat(F.lit("/"), F.col("target"))),
            )
        ),
    )
    each = candidates.select("page_id", "link", "occurrences", F.explode(F.array_distinct("paths")).alias("path"))
    known = pages.select(_tidy(url_path(F.col("url"))).alias("path")).distinct()
    alive = each.join(known.withColumn("_known", F.lit(1)), "path", "left")
    return (
        alive.groupBy("page_id", "link")
        .agg(F.max("occurrences").alias("occurrences"), F.max("_known").alias("_known"))
        .where(F.col("_known").isNull())
        .drop("_known")
    )


def record_failures(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """``(key, rule)`` for every rule a record breaks.

    A rule is a condition that must hold; null counts as broken. All rules are
    tried in one pass over the rows.
    """
    broken = [F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]
    return df.select(key, F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def rule_summary(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``(rule, failed, passed)`` with one wide aggregation, no shuffle of rows."""
    counted = [
        F.count_if(~F.coalesce(holds, F.lit(False))).alias(f"f{i}") for i, holds in enumerate(rules.values())
    ]
    rows = [F.struct(F.lit(name).alias("rule"), F.col(f"f{i}").alias("failed")) for i, name in enumerate(rules)]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *counted)
    tall = wide.select("rows", F.inline(F.array(*rows)))
    return tall.select("rule", "failed", (F.col("rows") - F.col("failed")).alias("passed"))
