import json

import pytest
from pyspark.sql import functions as F

from gristmill import scratch_path
from gristmill.operators import journal
from gristmill.sources import sinks

FIELDS = [f.name for f in journal.RECORD]


def _journal(spark, records):
    rows = [tuple(r.get(f) for f in FIELDS) for r in records]
    return spark.createDataFrame(rows, journal.RECORD)


def test_parse_keeps_objects_without_an_id(spark):
    lines = ['{"submission_id": "a", "tags": ["x"]}', "", "  ", "{bad", '{"metric": 1.5}', "[1]", ' {"task_id": "t"} ']
    got = journal.parse_lines(spark.createDataFrame([(line,) for line in lines], "value string")).collect()
    assert len(got) == 3 and {r.submission_id for r in got} == {"a", None}


def test_store_round_trip(spark):
    path = scratch_path(spark, "journal")
    assert sinks.journal_load(spark, path).count() == 0
    first = _journal(spark, [{"submission_id": "s1", "task_id": "007", "tags": ["ü"], "metric": 0.1, "is_bug": False}])
    sinks.journal_append(first, path)
    sinks.journal_append(_journal(spark, [{"submission_id": "s2", "task_id": "t"}]), path)
    got = {r.submission_id: r for r in sinks.journal_load(spark, path).collect()}
    assert got["s1"].tags == ["ü"] and got["s1"].metric == 0.1 and got["s2"].metric is None
    assert got["s2"].task_id == "t"
    assert got["s1"].task_id == "007"


def test_numeric_task_ids_stay_text(spark):
    path = scratch_path(spark, "journal")
    sinks.journal_append(_journal(spark, [{"submission_id": "s", "task_id": t} for t in ("007", "10")]), path)
    assert {r.task_id for r in sinks.journal_load(spark, path).collect()} == {"007", "10"}


def test_folders_of_a_journal_do_not_grow_with_its_tasks(spark, tmp_path):
    path = str(tmp_path / "journal")
    tasks = [f"t{i}" for i in range(600)] + [None, "a/b c", "ü=1%2F", "007"]
    for batch in "xy":
        sinks.journal_append(_journal(spark, [{"submission_id": f"{batch}{i}", "task_id": t} for i, t in enumerate(tasks)]), path)
    assert len(list((tmp_path / "journal").iterdir())) <= 67
    got = sorted((r.task_id or "", r.submission_id) for r in sinks.journal_load(spark, path).collect())
    assert got == sorted((t or "", f"{batch}{i}") for batch in "xy" for i, t in enumerate(tasks))
    one = sinks.journal_load(spark, path, "a/b c")
    assert sorted(r.submission_id for r in one.collect()) == ["x601", "y601"]
    folders = {f.parent.name for f in (tmp_path / "journal").glob("*/*.json")}
    assert len(folders) > 50 and "PartitionFilters: [isnotnull(task_folder" in one._jdf.queryExecution().toString()


def test_a_journal_with_a_folder_per_task_is_read_and_added_to(spark):
    path = scratch_path(spark, "journal")
    tasks = ["007", "t", "a/b", None]
    early = _journal(spark, [{"submission_id": f"old{i}", "task_id": t, "tags": ["x"]} for i, t in enumerate(tasks)])
    early.write.partitionBy("task_id").json(path)
    before = {(r.submission_id, r.task_id) for r in sinks.journal_load(spark, path).collect()}
    assert before == {(f"old{i}", t) for i, t in enumerate(tasks)}
    sinks.journal_append(_journal(spark, [{"submission_id": f"new{i}", "task_id": t} for i, t in enumerate(tasks)]), path)
    got = sinks.journal_load(spark, path)
    assert got.schema.names == FIELDS and got.count() == 8
    assert {(r.submission_id, r.task_id) for r in got.collect()} == before | {(f"new{i}", t) for i, t in enumerate(tasks)}
    assert {r.submission_id for r in sinks.journal_load(spark, path, "007").collect()} == {"old0", "new0"}


def test_markdown_folders(spark):
    path = scratch_path(spark, "log")
    sinks.write_journal_markdown(_journal(spark, [{"submission_id": "s", "task_id": "t", "tags": ["x"]}]), path)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert "## s" in lines and "- **tags**: x" in lines


def test_status_and_tags(spark):
    table = _journal(
        spark,
        [{"submission_id": "a", "is_bug": False, "tags": ["x"]}, {"submission_id": "b", "is_bug": True}, {"submission_id": "c"}],
    )
    assert [r.submission_id for r in journal.with_status(table, "success").collect()] == ["a"]
    assert {r.submission_id for r in journal.with_status(table, "buggy").collect()} == {"b", "c"}
    assert [r.submission_id for r in journal.with_tag(table, "x").collect()] == ["a"]
    with pytest.raises(ValueError):
        journal.with_status(table, "other")


def test_latest_puts_missing_times_last(spark):
    table = _journal(spark, [{"submission_id": i, "timestamp": t, "task_id": "t"} for i, t in (("a", "1"), ("b", None), ("c", "2"))])
    assert [r.submission_id for r in journal.latest(table, 3).collect()] == ["c", "a", "b"]
    array = json.loads(journal.to_json_array(journal.latest(table, 2)).first().history)
    assert [r["submission_id"] for r in array] == ["c", "a"]


def test_normalize_rejects(spark):
    columns = ["timestamp", "submission_id", "is_bug", "metric", "lower_is_better", "summary", "parent_id", "tags", "task_id"]
    good = [None, "s", "YES", "1.5", "0", "text", None, None, "t-1_A"]
    variants = {"is_bug": "perhaps", "metric": "much", "lower_is_better": "", "tags": '{"a":1}', "task_id": "a/b", "summary": None}
    rows = [tuple(good)] + [tuple(v if c == k else g for c, g in zip(columns, good, strict=True)) for k, v in variants.items()]
    records, rejects = journal.normalize(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)))
    kept = records.collect()
    assert len(kept) == 1 and kept[0].is_bug is True and kept[0].metric is None and kept[0].tags == []
    assert rejects.select("problem").distinct().count() == len(variants)


def test_lineage_is_not_multiplied_by_duplicates(spark):
    table = _journal(
        spark,
        [
            {"submission_id": "p", "metric": 1.0, "timestamp": "1", "task_id": "t"},
            {"submission_id": "p", "metric": 2.0, "timestamp": "2", "task_id": "t"},
            {"submission_id": "c", "metric": 5.0, "parent_id": "p", "task_id": "t"},
            {"submission_id": "d", "metric": 5.0, "parent_id": "gone", "task_id": "t"},
        ],
    )
    got = journal.lineage(table).collect()
    assert len(got) == 4
    assert [r.change for r in got if r.submission_id == "c"] == [3.0]
    assert [r.parent_metric for r in got if r.submission_id == "d"] == [None]


def test_tree_with_chain_star_cycle_and_missing_parent(spark):
    records = [{"submission_id": f"n{i}", "parent_id": f"n{i - 1}" if i else None, "task_id": "chain"} for i in range(70)]
    records += [{"submission_id": f"s{i}", "parent_id": "hub", "task_id": "star"} for i in range(50)]
    records += [{"submission_id": "hub", "task_id": "star"}]
    records += [{"submission_id": a, "parent_id": b, "task_id": "loop"} for a, b in (("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"))]
    records += [{"submission_id": "kid", "parent_id": "gone", "task_id": "orphan"}]
    got = {(r.task_id, r.submission_id): (r.root, r.depth) for r in journal.tree(_journal(spark, records)).collect()}
    assert len(got) == len(records)
    for i in range(70):
        assert got["chain", f"n{i}"] == ("n0", i)
    assert got["star", "s9"] == ("hub", 1) and got["star", "hub"] == ("hub", 0)
    assert all(got["loop", n] == (None, None) for n in "wxyz")
    assert got["orphan", "kid"] == ("kid", 0)


def test_best_follows_direction(spark):
    table = _journal(
        spark,
        [
            {"submission_id": str(i), "task_id": t, "metric": m, "lower_is_better": low, "is_bug": bug}
            for i, (t, m, low, bug) in enumerate(
                [("a", 1.0, True, False), ("a", 2.0, True, False), ("a", 0.1, True, True), ("b", 1.0, False, False), ("b", 2.0, False, False)]
            )
        ],
    )
    assert {r.task_id: r.best_metric for r in journal.best(table).collect()} == {"a": 1.0, "b": 2.0}


def test_markdown_lines(spark):
    blocks = journal.markdown(_journal(spark, [{"submission_id": "a", "summary": "first", "tags": ["x", "y"]}])).first().block
    assert blocks.splitlines()[0] == "## a" and "- **tags**: x, y" in blocks and "parent_id" not in blocks


def test_task_resolution(spark):
    df = spark.createDataFrame([("own", "env", "f"), ("", "env", "f"), (None, "", "f"), (None, None, None)], "a string, b string, c string")
    got = df.select(journal.resolve_task(F.col("a"), F.col("b"), F.col("c")).alias("t")).collect()
    assert [r.t for r in got] == ["own", "env", "task_f", "default_task"]


def test_a_trailing_line_break_is_no_task_id(spark):
    frame = spark.createDataFrame([("abc",), ("abc\n",), ("",), (None,), ("a b",), ("A_-9",)], "t string")
    assert [r[0] for r in frame.select(journal.valid_task_id(F.col("t"))).collect()] == [True, False, False, False, False, True]


def test_tree_of_a_long_chain_a_cycle_and_a_missing_parent(spark):
    rows = [("t", f"n{k}", f"n{k - 1}" if k else None) for k in range(300)]
    rows += [("t", "c1", "c2"), ("t", "c2", "c1"), ("t", "d", "c1"), ("t", "m", "gone"), ("u", "n1", "n0")]
    frame = spark.createDataFrame([(f"{k:05d}", *r) for k, r in enumerate(rows)], "timestamp string, task_id string, submission_id string, parent_id string")
    blank = {f.name: F.lit(None).cast(f.dataType) for f in journal.RECORD if f.name not in frame.columns}
    got = {(r.task_id, r.submission_id): (r.root, r.depth) for r in journal.tree(frame.withColumns(blank)).collect()}
    assert len(got) == len(rows)
    assert all(got["t", f"n{k}"] == ("n0", k) for k in range(300))
    assert got["t", "c1"] == got["t", "d"] == (None, None) and got["t", "m"] == ("m", 0) and got["u", "n1"] == ("n1", 0)
