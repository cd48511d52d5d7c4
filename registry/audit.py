"""Integrity checks over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import checks
from registry.tables import table


def broken_links(spark, d):
    return checks.broken_links(table(spark, d, "pages"))


def _judged_documents(spark, d):
    """Documents beside the mark that says whether they have labels."""
    labelled = table(spark, d, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    return table(spark, d, "documents").join(labelled, "doc_id", "left")


def _rules():
    return {
        "text_present": F.trim("text") != "",
        "lang_present": F.trim("lang") != "",
        "length_agrees": F.col("n_chars") == F.length("text"),
        "source_named": F.col("source").rlike("^src[0-9]+$"),
        "is_labelled": F.col("labelled"),
    }


def record_rules(spark, d):
    return checks.record_failures(_judged_documents(spark, d), "doc_id", _rules())


def record_rules_summary(spark, d):
    return checks.rule_summary(_judged_documents(spark, d), _rules())


QUERIES = {
    "broken_links": broken_links,
    "record_rules": record_rules,
    "record_rules_summary": record_rules_summary,
}

_RULES = {
    "text_present": "trim(text) <> ''",
    "lang_present": "trim(lang) <> ''",
    "length_agrees": "n_chars = length(text)",
    "source_named": "regexp_full_match(source, 'src[0-9]+')",
    "is_labelled": "doc_id in (select doc_id from labels)",
}
_TIDY = "case when {0} = '/' then '/' else regexp_replace({0}, '/$', '') end"


def _tidy(path: str) -> str:
    return _TIDY.format(f"regexp_replace(regexp_replace({path}, '/(\\./)+', '/', 'g'), '/+', '/', 'g')")


_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"

SQL = {
    "broken_links": f"""
        with found as (
          select page_id, regexp_replace({_PATH}, '[^/]*$', '') as folder,
                 unnest(list_concat(regexp_extract_all(html, '\\[[^\\]]*\\]\\(([^)]+)\\)', 1),
                                    regexp_extract_all(html, 'href="([^"]*)"', 1))) as link from pages),
        inner_links as (
          select *, regexp_replace(trim(link), '[#?].*$', '') as target from found
          where not regexp_matches(trim(link), '^(http://|https://|mailto:|ftp://|tel:)')),
        known as (select {_tidy(_PATH)} as path from pages)
        select page_id, link, count(*) as occurrences from inner_links
        where target <> ''
          and {_tidy("'/' || target")} not in (select path from known)
          and (target like '/%' or {_tidy("case when folder = '' then '/' else folder end || target")} not in (select path from known))
        group by 1, 2""",
    "record_rules": "\nunion all\n".join(
        f"select doc_id, '{name}' as rule from documents where not coalesce({holds}, false)" for name, holds in _RULES.items()
    ),
    "record_rules_summary": "\nunion all\n".join(
        f"""select '{name}' as rule, count(*) filter (where not coalesce({holds}, false)) as failed,
        count(*) filter (where {holds}) as passed from documents"""
        for name, holds in _RULES.items()
    ),
}
