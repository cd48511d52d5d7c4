import random

import pytest
from pyspark.sql import types as T

from conftest import SF
from gristmill import scratch_path
from gristmill.operators import checks, encode
from gristmill.plans import profile
from gristmill.sources import files, sinks


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_missing_files_are_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        files.scan_parquet(spark, str(tmp_path / "nowhere"))
    with pytest.raises(ValueError):
        files.list_files(spark, str(tmp_path), "xlsx")


def test_csv_types_and_missing_words(spark, tmp_path):
    _write(tmp_path / "a" / "one.csv", 'i,x,s,b,gone\n1,1.5,"say ""hi"", you",true,NA\nNULL,nan,N/A,False,\n3,2,z,,null\n')
    _write(tmp_path / "b" / "two.csv", "i,x,s,b,gone\n4,,w,true,\n")
    got = files.scan_csv(spark, str(tmp_path), missing=files.MISSING_WORDS)
    assert [f.dataType for f in got.schema] == [T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.StringType()]
    rows = {r.i: r for r in got.collect()}
    assert len(rows) == 4 and rows[1].s == 'say "hi", you' and rows[None].s is None and rows[3].gone is None
    assert rows[4].x is None


def test_file_type_rules(spark, tmp_path):
    _write(tmp_path / "only" / "a.csv", "x\n1\n")
    assert files.resolve_file_type(spark, str(tmp_path / "only")) == "csv"
    assert files.resolve_file_type(spark, str(tmp_path / "only"), configured="parquet") == "parquet"
    assert files.resolve_file_type(spark, SF) == "parquet"
    with pytest.raises(ValueError):
        files.resolve_file_type(spark, SF, "json")


def test_sample_files_is_repeatable():
    paths = [f"f{i:03d}" for i in range(100)]
    chosen = files.sample_files(paths, 0.3)
    assert len(chosen) == 30 and chosen == sorted(chosen) == files.sample_files(paths, 0.3)
    assert chosen == sorted(random.Random(42).sample(paths, 30))
    assert files.sample_files(["one"], 0.1) == ["one"] and files.sample_files(paths, 1.0) == paths
    with pytest.raises(ValueError):
        files.sample_files(paths, 0)


def test_profile_survives_writing_and_may_lack_parts(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("a", 3.0)], "c string, x double")
    done = profile.summarize(df)
    path = scratch_path(spark, "profile")
    sinks.write_profile_json(path, done.num, (done.cat, done.top))
    back = sinks.read_profile(spark, path)
    assert back["num"].first().P50 == 2.0 and back["cross"].count() == 0 and back["medians"].count() == 0
    assert sorted((r.value, r["rank"]) for r in back["top"].collect()) == [("a", 1), ("b", 2)]
    sinks.write_maps(path, encoding_map=encode.encoding_map(done.cat, done.top))
    maps = sinks.read_maps(spark, path)
    assert {(r.value, r.id) for r in maps["encoding_map"].collect()} == {("a", 1), ("b", 2), ("OTH", 0)}
    assert maps["fill_na_map"].count() == 0


def test_csv_types_hold_for_all_rows_and_files(spark, tmp_path):
    _write(tmp_path / "a.csv", "k,late,n\n" + "".join(f"{i},{i},{i}\n" for i in range(150_000)) + "150000,odd,\n")
    _write(tmp_path / "b.csv", 'n,k,late\n0.5,1,"two\nlines"\n,2,""\n')
    got = files.scan_csv(spark, str(tmp_path))
    assert [(f.name, f.dataType) for f in got.schema] == [("k", T.LongType()), ("late", T.StringType()), ("n", T.DoubleType())]
    assert got.count() == 150_003 and got.where("late = 'odd'").count() == 1
    assert {(r.k, r.late, r.n) for r in got.where("late = 'two\nlines' or n = 0.5").collect()} == {(1, "two\nlines", 0.5)}


def test_csv_misfits_are_listed(spark, tmp_path):
    _write(tmp_path / "a.csv", "i,x\n1,2.5\nseven,NA\n,3\n")
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("x", T.DoubleType())])
    bad = files.csv_misfits(spark, str(tmp_path), schema, missing=files.MISSING_WORDS).collect()
    assert [(r.file.rsplit("/", 1)[1], r.column, r.value) for r in bad] == [("a.csv", "i", "seven")]
    plain = files.csv_misfits(spark, str(tmp_path), schema).collect()
    assert {(r.column, r.value) for r in plain} == {("i", "seven"), ("x", "NA")}


def test_parquet_files_of_other_columns_or_types_are_refused(spark, tmp_path):
    spark.range(3).selectExpr("id as x", "id as y").coalesce(1).write.parquet(str(tmp_path / "a"))
    same = str(tmp_path / "a")
    assert files.scan_parquet(spark, same).count() == 3
    spark.range(3).selectExpr("id as x", "id as y", "id as z").coalesce(1).write.parquet(str(tmp_path / "b"))
    listed = files.list_files(spark, str(tmp_path))
    with pytest.raises(ValueError, match="other columns"):
        files.scan_parquet(spark, sorted(listed))
    assert files.scan_parquet(spark, sorted(listed), same_schema=False).count() == 6
    spark.range(3).selectExpr("cast(id as string) as x", "id as y").coalesce(1).write.parquet(str(tmp_path / "c" / "d"))
    with pytest.raises(ValueError):
        files.scan_parquet(spark, [f for f in files.list_files(spark, str(tmp_path)) if "/b/" not in f])


def test_a_pattern_names_folders_of_part_files_as_well(spark, tmp_path):
    spark.range(5).repartition(3).write.parquet(str(tmp_path / "one day" / "t.parquet"))
    spark.range(5, 7).coalesce(1).write.parquet(str(tmp_path / "two" / "[x]" / "t.parquet" / "deep"))
    spark.range(90).write.parquet(str(tmp_path / "one day" / "other.parquet"))
    single = next((tmp_path / "one day" / "t.parquet").glob("*.parquet"))
    (tmp_path / "three").mkdir()
    (tmp_path / "three" / "t.parquet").write_bytes(single.read_bytes())
    ids = [r.id for r in spark.read.parquet(str(single)).collect()]
    root = str(tmp_path)
    for pattern in ("t.parquet", "{t,u}.parquet", "[^op]*.parquet"):
        got = files.scan_parquet(spark, root, ["id"], pattern)
        assert sorted(r.id for r in got.collect()) == sorted([*range(7), *ids]), pattern
    assert files.scan_parquet(spark, f"file:{root}//one day/./", pattern="t.parquet").count() == 5
    assert files.scan_parquet(spark, root).count() == 97 + len(ids)
    parts = len(list(tmp_path.glob("**/t.parquet/**/*.parquet")))
    assert len(files.list_files(spark, root, pattern="t.parquet")) == parts + 1
    with pytest.raises(FileNotFoundError):
        files.scan_parquet(spark, root, pattern="u.parquet")
    spark.range(3).selectExpr("cast(id as string) as id").write.parquet(str(tmp_path / "four" / "t.parquet"))
    with pytest.raises(ValueError):
        files.scan_parquet(spark, root, pattern="t.parquet")


def test_scan_reads_only_empty_fields_as_missing(spark, tmp_path):
    _write(tmp_path / "a.csv", "s\nNA\nNone\n\"\"\nx\n")
    assert sorted(r.s or "" for r in files.scan_csv(spark, str(tmp_path)).collect()) == ["", "NA", "None", "x"]


def test_csv_files_of_other_columns_are_refused(spark, tmp_path):
    _write(tmp_path / "a.csv", "x,y\n1,2\n")
    _write(tmp_path / "b.csv", "x,z\n1,2\n")
    with pytest.raises(ValueError, match="b.csv"):
        files.scan_csv(spark, str(tmp_path))
    _write(tmp_path / "b.csv", "x,x\n1,2\n")
    with pytest.raises(ValueError):
        files.scan_csv(spark, str(tmp_path / "b.csv"))


def test_csv_keeps_blanks_and_line_breaks(spark, tmp_path):
    rows = [(1, " a ", "x\ny"), (2, "", 'say "hi", \r\n'), (3, None, "\ttab")]
    frame = spark.createDataFrame(rows, "i long, s string, t string")
    sinks.write_csv(frame, str(tmp_path / "out"))
    back = files.scan_csv(spark, str(tmp_path / "out"), missing=[]).orderBy("i").collect()
    assert [(r.i, r.s, r.t.replace("\r\n", "\n")) for r in back] == [(i, s, t.replace("\r\n", "\n")) for i, s, t in rows]


def test_summarize_files_from_csv(spark, tmp_path):
    for i in range(4):
        _write(tmp_path / f"p{i}.csv", f"k,x\na,{i}\nb,{i}\n")
    done = profile.summarize_files(spark, str(tmp_path), sample_ratio=0.5)
    assert done.cat.first().nunique == 2 and done.roles.numeric == ["x"]
    assert done.top.first()["count"] == 2


def test_fingerprint_depends_on_rows_and_names(spark):
    one, two = spark.range(5).selectExpr("id as x", "id as y"), spark.range(6).selectExpr("id as x", "id as y")
    ids = [files.dataset_fingerprint("t", t).first().fingerprint for t in (one, one, two, one.selectExpr("x", "y as z"))]
    assert ids[0] == ids[1] and len(set(ids)) == 3 and all(len(i) == 12 for i in ids)


def test_links(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://h.com/docs/a", '<a href="b">x</a> <a href="/docs/b#top">y</a> <a href="missing">z</a> [m](../up)'),
            (2, "http://h.com/docs/b", '<a href="#here">x</a> <a href="https://o.com/">y</a> <a href="">e</a> <a href="docs/a?q=1">r</a>'),
            (3, "http://h.com", '<a href="docs/nope">x</a><a href="docs/nope">x</a>'),
        ],
        "page_id bigint, url string, html string",
    )
    got = {(r.page_id, r.link, r.occurrences) for r in checks.broken_links(pages).collect()}
    assert got == {(1, "missing", 1), (1, "../up", 1), (3, "docs/nope", 2)}
