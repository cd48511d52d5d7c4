import pytest
from pyspark.sql import functions as F

from gristmill import scratch_path
from gristmill.operators import journal
from gristmill.plans import isolation, profile, submission
from gristmill.sources import sinks

RAW = "timestamp string, submission_id string, is_bug string, metric string, lower_is_better string, summary string, parent_id string, tags string, task_id string"


def _raw(spark, *rows):
    names = [f.split(" ")[0] for f in RAW.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RAW)


def _record(name, **other):
    return {"submission_id": name, "is_bug": "no", "metric": "1.5", "lower_is_better": "no", "summary": "s", "task_id": "t", **other}


def test_submission_flags_and_stores(spark):
    path, log = scratch_path(spark, "journal"), scratch_path(spark, "log")
    first = submission.submit(_raw(spark, _record("a"), _record("b", is_bug="yes", metric="2")), path, log, now="2024-01-01")
    assert all(r["status"] == "ok" and r["warnings"] == [] for r in first.collect())
    second = _raw(
        spark, _record("a"), _record("c", metric=None), _record("d"), _record("d"), _record("a", task_id=None),
        _record("e", is_bug="perhaps"), _record("f", timestamp="2020"), _record("g", task_id="../up"),
    )
    got = submission.submit(second, path, log, task="own", now="2024-01-02").collect()
    told = sorted((r["submission_id"], r["task_id"], r["status"], len(r["warnings"]), r["problem"]) for r in got)
    assert told == [
        ("a", "own", "ok", 0, None),
        ("a", "t", "ok", 1, None),
        ("c", "t", "ok", 1, None),
        ("d", "t", "ok", 1, None),
        ("d", "t", "ok", 1, None),
        ("e", "t", "error", 0, "is_bug is not a boolean"),
        ("f", "t", "ok", 0, None),
        ("g", "../up", "error", 0, "task_id has other characters"),
    ]
    stored = sinks.journal_load(spark, path)
    assert stored.count() == 8 and stored.where("submission_id = 'f' and timestamp = '2020'").count() == 1
    assert stored.where("timestamp = '2024-01-01'").count() == 2 and stored.where("submission_id = 'b' and metric is null").count() == 1
    assert {r["task_id"] for r in journal.duplicates(stored).collect()} == {"t"}
    assert spark.read.text(log).where("value like '## %'").count() == 8


def test_nothing_submitted(spark):
    path = scratch_path(spark, "journal")
    assert submission.submit(_raw(spark), path).count() == 0


def test_a_failing_column_is_listed(spark):
    df = spark.range(200).select(
        "id",
        *[(F.col("id") * k).alias(f"n{k}") for k in range(6)],
        (F.lit(1) / (F.col("id") - 7)).alias("ratio"),
        F.when(F.col("id") == 9, F.lit("x")).otherwise("1").cast("int").alias("typed"),
        F.concat(F.lit("c"), F.col("id") % 3).alias("kind"),
        (F.lit(1) / (F.col("id") - 8)).cast("string").alias("broken"),
    )
    done = profile.summarize(df, group="kind", cross_pairs=[["kind", "broken"], ["kind", "n1"]], isolate=True)
    assert {r["feature"]: r["problem"] for r in done.errors.collect()} == {
        "ratio": "DIVIDE_BY_ZERO",
        "typed": "CAST_INVALID_INPUT",
        "broken": "DIVIDE_BY_ZERO",
    }
    sound = ["id", *[f"n{k}" for k in range(6)]]
    assert sorted(r["feature"] for r in done.num.collect()) == sorted(sound)
    alone = profile.summarize(df.select(*sound, "kind"), group="kind", cross_pairs=[["kind", "n1"]])
    for name in ("num", "cat", "top", "medians", "cross"):
        assert sorted(map(str, getattr(done, name).collect())) == sorted(map(str, getattr(alone, name).collect()))


def test_an_error_of_all_columns_is_raised(spark):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        profile.summarize(spark.range(5).select((1 / F.col("id")).alias("a"), (2 / F.col("id")).alias("b")), isolate=True)


def test_without_failures_one_plan_runs(spark):
    calls = []
    done, failures = isolation.isolated(["a", "b", "c"], lambda part: calls.append(part) or (spark.range(1),))
    assert calls == [["a", "b", "c"]] and len(done) == 1 and not failures


def test_submissions_of_many_tasks_write_few_folders(spark, tmp_path):
    path = str(tmp_path / "journal")
    rows = [_record(f"s{i}", task_id=f"t{i}") for i in range(400)]
    for warned in (0, 1):
        told = submission.submit(_raw(spark, *rows), path).collect()
        assert len(told) == 400 and {len(r["warnings"]) for r in told} == {warned}
    assert len(list((tmp_path / "journal").iterdir())) <= 66
    stored = sinks.journal_load(spark, path).groupBy("task_id", "submission_id").count().collect()
    assert {(r["task_id"], r["submission_id"], r["count"]) for r in stored} == {(f"t{i}", f"s{i}", 2) for i in range(400)}
