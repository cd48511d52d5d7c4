"""Submitting records to the journal as one plan."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import journal
from gristmill.operators.lookup import settled
from gristmill.sources import sinks


def submit(raw: DataFrame, directory: str, markdown: str | None = None, task: str | None = None, now: str | None = None) -> DataFrame:
    """Stamp, check, flag and append the records of ``raw`` (text columns, as for
    ``journal.normalize``); one answer per row.

    ``(status, task_id, submission_id, warnings, problem)``: a row that breaks a rule is
    answered with ``error`` and its problem, and not stored; all others are stored as
    ``ok``, with their warnings. Records without a time get ``now`` (default: the time of
    the call, in UTC), those without a task get ``task``, else the default task. Flags
    refer to the journal as it was before, and to the records submitted with them.
    With ``markdown`` the readable blocks are written there as well.

    Records and answers are written before the append, so neither can see it.
    """
    spark = raw.sparkSession
    stamp = now or datetime.now(timezone.utc).isoformat()
    nothing = F.lit(None).cast("string")
    stamped = raw.withColumns(
        {
            "timestamp": F.coalesce("timestamp", F.lit(stamp)),
            "task_id": journal.resolve_task(F.col("task_id"), F.lit(task).cast("string"), nothing),
        }
    )
    good, bad = journal.normalize(stamped)
    flagged = settled(journal.warnings(good, sinks.journal_load(spark, directory)))
    answers = flagged.select(F.lit("ok").alias("status"), "task_id", "submission_id", "warnings", nothing.alias("problem"))
    refused = bad.select(
        F.lit("error").alias("status"), "task_id", "submission_id", F.array().cast("array<string>").alias("warnings"), "problem"
    )
    result = settled(answers.unionByName(refused))
    records = flagged.drop("warnings")
    sinks.journal_append(records, directory)
    if markdown is not None:
        sinks.write_journal_markdown(records, markdown)
    return result
