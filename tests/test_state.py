"""Tables and collections that streams keep."""

import random

from pyspark.sql import functions as F

from catalogkit.operators import rules
from catalogkit.streaming import answers, state

SCHEMA = "k long, at long, v string"


def latest(rows):
    out = {}
    for k, at, v in rows:
        if k not in out or (at, v) > out[k]:
            out[k] = (at, v)
    return out


def held(df):
    return {r.k: (r["at"], r.v) for r in df.collect()}


def test_latest_rows_over_batches_and_retries(spark, tmp_path):
    path, rng = str(tmp_path / "t"), random.Random(1)
    merge = state.upsert_latest_into(path, "k", "at", buckets=8)
    rows: list = []
    for number in range(6):
        new = [(rng.choice([None, *range(40)]), rng.randrange(10**6), f"v{rng.randrange(5)}") for _ in range(25)]
        rows += new
        batch = spark.createDataFrame(new, SCHEMA)
        merge(batch, number)
        merge(spark.createDataFrame([(1, 10**9, "a retry changes nothing")], SCHEMA), number)
        assert held(state.read_latest(spark, path)) == latest(rows)
    assert state.committed(spark, path) == [4, 5]
    merge(spark.createDataFrame([], SCHEMA), 6)
    assert state.committed(spark, path) == [4, 5]
    assert held(state.read_latest(spark, path, keys=[3, 4, 777])) == {k: v for k, v in latest(rows).items() if k in (3, 4)}


def test_a_batch_rewrites_its_buckets_only_and_readers_keep_the_state_before(spark, tmp_path):
    path = str(tmp_path / "t")
    merge = state.upsert_latest_into(path, "k", "at", buckets=16)
    merge(spark.createDataFrame([(k, 1, "a") for k in range(1_000)], SCHEMA), 0)
    before = state.read_latest(spark, path)
    merge(spark.createDataFrame([(5, 2, "b"), (5, 3, "c")], SCHEMA), 1)
    assert [x.name for x in (tmp_path / "t" / "v=1").iterdir() if x.is_dir()] == [f"__bucket={spark.range(5, 6).select(state.bucket_of('id', 16)).first()[0]}"]
    assert held(before)[5] == (1, "a") and held(state.read_latest(spark, path))[5] == (3, "c")
    assert state.read_latest(spark, path).count() == 1_000


def test_a_batch_that_failed_before_its_manifest_is_written_anew(spark, tmp_path):
    path = str(tmp_path / "t")
    merge = state.upsert_latest_into(path, "k", "at", buckets=4)
    merge(spark.createDataFrame([(1, 1, "a"), (2, 1, "a")], SCHEMA), 0)
    spark.createDataFrame([(1, 9, "half written", 0)], SCHEMA + ", __bucket int").write.partitionBy("__bucket").parquet(f"{path}/v=1")
    assert held(state.read_latest(spark, path)) == {1: (1, "a"), 2: (1, "a")}
    merge(spark.createDataFrame([(2, 2, "b")], SCHEMA), 1)
    assert held(state.read_latest(spark, path)) == {1: (1, "a"), 2: (2, "b")}


def brute_retries(requests, wait, watermark):
    out, by = [], {}
    for k, n, at, ok in sorted(requests, key=lambda r: (r[2], r[1])):
        by.setdefault(k, []).append((n, at, ok))
    for k, rows in by.items():
        due = None
        for attempt, (n, at, ok) in enumerate(rows, 1):
            if due is not None and due <= at:
                out.append((k, None, due, attempt - 1, "due"))
            out.append((k, n, at, attempt, "first" if attempt == 1 else "again"))
            due = None if ok else at + wait
            if ok:
                break
        if due is not None and due <= watermark:
            out.append((k, None, due, attempt, "due"))
    return sorted(out, key=str)


def test_collection_goes_on_after_stops(spark, tmp_path):
    rng = random.Random(2)
    requests = [(rng.randrange(6), i, i * 400 + rng.randrange(300), rng.random() < 0.15) for i in range(60)]
    df = spark.createDataFrame(requests, "k long, n long, s long, ok boolean").select("k", "n", F.timestamp_seconds("s").alias("at"), "ok")
    for stream in state.arrivals(df, F.floor(F.col("n") / 20).cast("int"), 3, str(tmp_path / "in")):
        found = state.append_to(state.collect_with_retries(stream, "k", "n", "at", "ok", 1_500, "0 seconds"), str(tmp_path / "out"), str(tmp_path / "c"))
    got = [(r.k, r.n, r.s, r.attempt, r.action) for r in found.select("k", "n", F.unix_seconds("at").alias("s"), "attempt", "action").collect()]
    assert sorted(got, key=str) == brute_retries(requests, 1_500, max(r[2] for r in requests))


def test_collection_of_many_keys(spark, tmp_path):
    """Ties of time and timers, null keys, and timers that end just at the watermark."""
    requests = [(k, 10 * k + n, s, ok) for k in range(400) for n, s, ok in ((0, 100 + k % 5, False), (1, 100 + k % 5, k % 7 == 0), (2, 1_600 + k % 5, k % 3 == 0), (3, 3_000 + k, False))] + [(None, 9_999, 50, False), (401, 9_998, 5_000, False)]
    requests = [r for r in requests if r[2] != 3_399] + [(402, 9_997, 3_500, False)]
    df = spark.createDataFrame(requests, "k long, n long, s long, ok boolean").select("k", "n", F.timestamp_seconds("s").alias("at"), "ok")
    for stream in state.arrivals(df, (F.unix_seconds("at") >= 1_500).cast("int"), 2, str(tmp_path / "in")):
        collected = state.collect_with_retries(stream, "k", "n", "at", "ok", 1_500, "0 seconds")
        assert "TransformWithState" not in collected._jdf.queryExecution().analyzed().toString()  # which calls the worker for each key, many times
        found = state.append_to(collected, str(tmp_path / "out"), str(tmp_path / "c"))
    got = [(r.k, r.n, r.s, r.attempt, r.action) for r in found.select("k", "n", F.unix_seconds("at").alias("s"), "attempt", "action").collect()]
    assert sorted(got, key=str) == brute_retries(requests, 1_500, 5_000)


def test_sessions_of_late_answers(spark, tmp_path):
    rows = [(1, 0, "a", 0), (1, 600, "b", 1), (1, 300, "a", 1), (2, 50_000, "a", 1), (1, 10, "late", 2), (1, 49_000, "c", 2), (2, 200_000, "z", 3)]
    df = spark.createDataFrame(rows, "u long, s long, g string, part int").select("u", F.timestamp_seconds("s").alias("ts"), "g", "part", F.lit(True).alias("ok"))
    names = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "g string, label string")
    for stream in state.arrivals(df.drop("part").withColumn("p", F.lit(0)).drop("p").join(df.select("u", "ts", "part"), ["u", "ts"]), F.col("part"), 4, str(tmp_path / "in")):
        joined = answers.with_category(stream, names, "g", "label", "other")
        found = state.append_to(answers.sessions(joined, "u", "ts", "ok", "30 minutes", "1 hour", "label"), str(tmp_path / "out"), str(tmp_path / "c"))
    got = sorted((r.u, r.s, r.total, r.categories) for r in found.select("u", F.unix_seconds("started").alias("s"), "total", "categories").collect())
    assert got == [(1, 0, 3, ["A", "B"]), (1, 49_000, 1, ["C"]), (2, 50_000, 1, ["A"])]


def test_column_report(spark):
    df = spark.createDataFrame([("a", None), (" ", "x"), ("b", "")], "id string, name string")
    assert sorted(map(tuple, rules.column_report(df, ("id", "name", "none")).collect())) == [("id", True, 3, 1), ("name", True, 3, 2), ("none", False, 3, 3)]
    assert [tuple(r) for r in rules.column_report(df.limit(0), ("id", "x")).collect()] == [("id", True, 0, 0), ("x", False, 0, 0)]
