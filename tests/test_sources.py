from pyspark.sql import functions as F

from catalogkit.sources import files
from catalogkit.streaming import answers


def test_csv_with_mark_trims_and_quoted_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿id,name,notes\n1, A ,"x\ny"\n,,\n2,,"say ""hi"""\n'.encode())
    rows = [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv"), "id string, name string, notes string").collect()]
    assert rows == [("1", "A", "x\ny"), ("2", None, 'say "hi"')]


def test_csv_sink_projects(spark, tmp_path):
    files.write_csv(spark.createDataFrame([(1, "a")], "x int, y string"), str(tmp_path / "o"), ["y", "z"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "o")).collect()] == [("a", None)]


def test_json_tables(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1"}, {"id": "2"}]')
    assert files.read_json_table(spark, str(tmp_path / "a.json"), "id string").count() == 2
    assert files.read_json_table(spark, str(tmp_path / "none.json"), "id string").count() == 0


def test_search_responses(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"brand_id": "a", "results": [{"domain": "", "_score": 1.5}, {"domain": "a.io"}]}')
    row = files.read_search_responses(spark, str(tmp_path)).first()
    assert row.brand_id == "a" and [x.domain for x in row.results] == ["", "a.io"]


def test_marks_and_remap(spark):
    df = spark.sql("SELECT map('a', named_struct('wordmark', true), 'b', named_struct('wordmark', false)) marks, array('c', '') auto, array('a') manual")
    marks = files.marked_ids(df, ("auto", "manual"), "marks", "wordmark")
    assert sorted(r.id for r in marks.collect()) == ["a", "c"]
    got = files.remapped_ids(marks, spark.createDataFrame([("a", "a2"), ("c", "a")], "old string, new string"), "old", "new")
    assert sorted(r.id for r in got.collect()) == ["a", "a2", "c"]


def test_inventory_and_orphans(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.SVG").write_text("xx")
    (tmp_path / "b.png").write_text("x")
    got = files.inventory(spark, str(tmp_path))
    assert {(r.name, r.format, r.size) for r in got.collect()} == {("a.SVG", "svg", 2), ("b.png", "png", 1)}
    assert {r["size"] for r in files.folder_size(got).collect()} == {1, 2}
    local = got.withColumn("path", F.substring_index("path", str(tmp_path), -1))
    assert {(r.folder, r.depth, r.own_files, r.own_size, r.files, r["size"]) for r in files.folder_rollup(local).collect()} == {("", 0, 1, 1, 2, 3), ("d", 1, 1, 2, 1, 2)}
    assert [r.name for r in files.orphans(got, spark.createDataFrame([("b.png",)], "name string"), "name").collect()] == ["a.SVG"]


def test_variants_of_a_plain_string(spark):
    df = spark.sql("SELECT 1 id, 'f.svg' file, map('dark', 'w.svg') wordmark")
    got = files.expanded_variants(df, {"file": False, "wordmark": True}, ("id",))
    assert sorted(map(tuple, got.collect())) == [(1, "dark", "w.svg", True), (1, "default", "f.svg", False)]


def test_stream_equals_batch_and_merge(spark, tmp_path):
    src = tmp_path / "e.parquet"
    rows = spark.sql("SELECT id, timestamp_seconds(1700000000 + id * 5000) ts, id % 3 g, id % 2 = 0 ok, id v FROM range(100)")
    rows.write.parquet(str(src))
    stats = answers.windowed_stats(answers.read_events(spark, str(src)), "ts", "g", "ok", "v")
    got = answers.run_to_table(stats, str(tmp_path / "t"), str(tmp_path / "c"))
    want = rows.groupBy(F.date_trunc("day", "ts").alias("window_start"), "g").agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("correct"), F.sum("v").alias("latency"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    (tmp_path / "src2").mkdir()
    again = answers.run_to_table(stats, str(tmp_path / "t"), str(tmp_path / "c"))
    assert again.count() == want.count()


def test_stream_of_a_folder_a_file_and_a_pattern(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "t"))
    file = next((tmp_path / "t").glob("*.parquet"))
    for path in (tmp_path / "t", file, tmp_path / "t" / "part-*"):
        got = files.stream_parquet(spark, str(path))
        made = answers.run_to_table(got.groupBy().count(), str(tmp_path / "o" / path.name.replace("*", "_")), str(tmp_path / "c" / path.name.replace("*", "_")))
        assert made.first()["count"] == spark.read.parquet(str(path)).count()


def test_sessions(spark, tmp_path):
    src = tmp_path / "s.parquet"
    spark.sql("SELECT 1 u, timestamp_seconds(t) ts, true ok FROM VALUES (0), (600), (9000) x(t)").write.parquet(str(src))
    s = answers.sessions(answers.read_events(spark, str(src)), "u", "ts", "ok")
    assert sorted(r.total for r in answers.run_to_table(s, str(tmp_path / "t"), str(tmp_path / "c")).collect()) == [1, 2]


def test_folder_rollup_equals_a_recursive_sum(spark):
    paths = ["a/b/c/f1", "a/b/f2", "/a//b/f3", "g", None, "a/x/y/z/f4", "a/b/c/f5"]
    rows = [(p, None if k == 1 else 10**k) for k, p in enumerate(paths)]
    want: dict = {}
    for p, size in rows:
        if p is None:
            continue
        parts = [x for x in p.split("/") if x]
        for depth in range(len(parts)):
            own, n = depth == len(parts) - 1, want.setdefault("/".join(parts[:depth]), [depth, 0, 0, 0, 0])
            for at, v in enumerate((own, own * (size or 0), 1, size or 0), 1):
                n[at] += v
    got = files.folder_rollup(spark.createDataFrame(rows, "path string, size long"))
    assert {r[0]: list(r[1:]) for r in got.collect()} == want
    assert files.folder_rollup(spark.createDataFrame([], "path string, size long")).count() == 0


def test_sources_are_pruned_merged_and_bad_lines_set_aside(spark, tmp_path):
    path = str(tmp_path / "t")
    lines = [("a", '{"id": 1, "n": 5, "x": "q"}'), ("a", '{"id": 2,'), ("b", '{"id": 3, "y": true}'), ("b", '{"id": "no number"}'), ("c", "nothing")]
    files.write_sources(spark.createDataFrame(lines, "source string, value string"), path, "source", "text")
    one = spark.createDataFrame([], "id long, n int, x string").schema
    other = spark.createDataFrame([], "id int, y boolean").schema
    good, bad = files.read_sources(spark, path, [one, other], "source")
    assert sorted(map(tuple, good.collect())) == [(1, 5, "q", None, "a"), (3, None, None, True, "b")]
    assert sorted((r.source, r.corrupt_record) for r in bad.collect()) == [("a", '{"id": 2,'), ("b", '{"id": "no number"}'), ("c", "nothing")] and bad.count() == 3
    only, _ = files.read_sources(spark, path, [one, other], "source", ["b"])
    plan = only._jdf.queryExecution().executedPlan()
    assert only.count() == 1 and "PartitionFilters: [" in plan.toString() and "source" in plan.toString().split("PartitionFilters: [")[1].split("]")[0]
    scan = plan.collectLeaves().apply(0)
    only._jdf.queryExecution().toRdd().count()
    assert scan.metrics().apply("numFiles").value() == 2
    import pytest

    with pytest.raises(ValueError):
        files.merged_schema([one, spark.createDataFrame([], "id string").schema])


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'say "hi", \n there', " a "), (2, None, "x"), (3, "back\\slash", '"'), (4, "é", "")]
    df = spark.createDataFrame(rows, "id int, notes string, name string")
    files.write_csv(df, str(tmp_path / "o"), ["id", "notes", "name"])
    got = files.read_csv(spark, str(tmp_path / "o"), df.schema)
    assert sorted(map(tuple, got.collect())) == [(1, 'say "hi", \n there', "a"), (2, None, "x"), (3, "back\\slash", '"'), (4, "é", None)]
