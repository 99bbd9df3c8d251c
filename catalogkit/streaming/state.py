"""Keyed state that streams keep: tables of the latest rows, and collections with retries."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

from catalogkit.sources import shared

MANIFESTS = "_manifests"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arrivals(df: DataFrame, part: Column, n: int, path: str) -> Iterator[DataFrame]:
    """The rows of ``df`` as a stream of files of which part after part (0 to n - 1) arrives: yields the
    stream after each arrival. The rows are written once."""
    spark = df.sparkSession
    df.withColumn("__part", part).write.partitionBy("__part").parquet(f"{path}/waiting")
    for k in range(n):
        if f"__part={k}" in shared.names(spark, f"{path}/waiting"):
            shared.move(spark, f"{path}/waiting/__part={k}", f"{path}/there/{k}")
        yield spark.readStream.schema(df.schema).parquet(f"{path}/there/*")


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose manifest is there, in order."""
    return sorted(int(name.removesuffix(".json")) for name in shared.names(spark, f"{path}/{MANIFESTS}") if name.endswith(".json"))


def manifest(spark: SparkSession, path: str, number: int) -> dict:
    """``schema``, ``buckets`` (how many) and ``held``: bucket -> number of the batch that wrote it last."""
    return json.loads(shared.read_text(spark, f"{path}/{MANIFESTS}/{number:012}.json"))


def folders(path: str, held: dict[str, int], only: set[int] | None = None) -> list[str]:
    return [f"{path}/v={v}/__bucket={b}" for b, v in held.items() if only is None or int(b) in only]


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_latest(spark: SparkSession, path: str, number: int | None = None, keys: list | None = None) -> DataFrame:
    """The state after a batch (the last one by default); for some ``keys`` only their buckets are read."""
    done = committed(spark, path)
    state = manifest(spark, path, done[-1] if number is None else number)
    only = None
    if keys is not None:
        asked = spark.createDataFrame([(k,) for k in keys], StructType([StructType.fromJson(state["schema"])[state["key"]]]))
        only = {r.b for r in asked.select(bucket_of(state["key"], state["buckets"]).alias("b")).distinct().collect()}
    there = folders(path, state["held"], only)
    rows = spark.read.schema(StructType.fromJson(state["schema"])).parquet(*there) if there else spark.createDataFrame([], StructType.fromJson(state["schema"]))
    return rows if keys is None else rows.where(F.col(state["key"]).isin(keys))


def upsert_latest_into(path: str, key: str, at: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the latest row of each key in a table at ``path``.

    Keys are dealt to ``buckets`` by hash. A batch is reduced to the latest row of each key, and
    rewrites only the buckets of its keys, in a folder of its own (``v=<batch>``); then a manifest that names the
    folder of every bucket appears in one step. Until then readers see the state before. A batch that comes again after
    its manifest was written changes nothing, one that failed before is written anew from the
    same state. Folders that only manifests before the last two name are deleted.

    Of rows of one key and time the one with the greatest other values stays, and rows of the batch before those of the
    state. A null key is a key. An empty batch writes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = committed(spark, path)
        if done and number <= done[-1]:
            return
        before = manifest(spark, path, done[-1]) if done else {"held": {}, "buckets": buckets}
        if before["buckets"] != buckets:
            raise ValueError(f"the table has {before['buckets']} buckets")
        rest = [c for c in batch.columns if c != key]
        latest = lambda rows, *by: rows.groupBy(*by, key).agg(F.max_by(F.struct(*rest), F.struct(at, "__new", *rest)).alias("__row")).select(*by, key, "__row.*")
        new = latest(batch.withColumn("__new", F.lit(1)), ).withColumn("__new", F.lit(1)).withColumn("__bucket", bucket_of(key, buckets)).persist()
        touched = {r["__bucket"] for r in new.select("__bucket").distinct().collect()}  # at most all buckets
        if not touched:
            new.unpersist()
            return
        old = folders(path, before["held"], touched)
        if old:
            there = spark.read.schema(batch.schema).parquet(*old).withColumn("__new", F.lit(0)).withColumn("__bucket", bucket_of(key, buckets))
            new_rows = latest(new.unionByName(there).repartition("__bucket"), "__bucket")
        else:
            new_rows = new.drop("__new").repartition("__bucket")
        new_rows.select(*batch.columns, "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/v={number}")
        new.unpersist()
        held = before["held"] | {str(b): number for b in touched}
        shared.write_text(spark, f"{path}/{MANIFESTS}/{number:012}.json", json.dumps({"schema": batch.schema.jsonValue(), "key": key, "buckets": buckets, "held": held}))
        if len(done) > 1:
            used = set(folders(path, held)) | set(folders(path, before["held"]))
            for folder in set(folders(path, manifest(spark, path, done[-2])["held"])) - used:
                shared.delete(spark, folder)
            shared.delete(spark, f"{path}/{MANIFESTS}/{done[-2]:012}.json")

    return merge


def attempts_of(wait_ms: int) -> Callable[..., Iterator[pd.DataFrame]]:
    """Attempts at the keys of a bucket until one succeeds, for ``applyInPandasWithState``: see ``collect_with_retries``. Rows have
    ``key`` (text), ``number``, ``us`` (their time in microseconds) and ``ok``; times go out in milliseconds."""

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: (done, attempts, due) for k, done, attempts, due in json.loads(state.get[0])} if state.exists else {}
        new = (False, 0, None)
        came = [row for b in frames for row in zip(b["us"].tolist(), b["number"].tolist(), b["key"].tolist(), b["ok"].tolist()) if not held.get(row[2], new)[0]] if not state.hasTimedOut else []
        rows = []
        for us, number, k, ok in sorted(came, key=lambda r: r[:2]):
            done, attempts, due = held.get(k, new)
            if done:
                continue
            at = us // 1000
            if due is not None and due <= at:
                rows.append((k, None, due, attempts, "due"))
            rows.append((k, number, at, attempts + 1, "again" if attempts else "first"))
            held[k] = (bool(ok), attempts + 1, None if ok else at + wait_ms)
        now = state.getCurrentWatermarkMs()
        for k, (done, attempts, due) in held.items():
            if due is not None and due <= now:
                rows.append((k, None, due, attempts, "due"))
                held[k] = (done, attempts, None)
        state.update((json.dumps([(k, *v) for k, v in held.items()]),))
        if waiting := [due for _, _, due in held.values() if due is not None]:
            state.setTimeoutTimestamp(max(min(waiting) - 1, 1))  # comes once the watermark is beyond it
        if rows:
            yield pd.DataFrame(rows, columns=["key", "number", "at", "attempt", "action"]).astype({"number": "Int64"})

    return step


def collect_with_retries(requests: DataFrame, key: str, number: str, at: str, succeeded: str, wait: int, late: str = "1 hour", buckets: int = 1_024) -> DataFrame:
    """What a resumable collector does with a stream of requests (``succeeded``: how the attempt would end): rows of
    ``key``, request ``number``, ``at`` (to the millisecond), ``attempt``, ``action``.

    A key's first request is tried (``first``); after an error the next one is tried again (``again``), after
    a success none is. If no request comes within ``wait`` seconds after an error, a timer of event time tells
    that the key is ``due`` (with no number). State and timers live in the checkpoint, so that a stopped stream goes
    on where it was. Of rows beyond the watermark (``late``) nothing is promised.

    Keys are dealt to ``buckets`` by hash, which have one state and one timer (the first that is due) for all their keys: a call
    into Python takes milliseconds, so there is none for each key. A stream keeps the number of its buckets."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # state on disk, not on the heap
    types = requests.schema
    schema = StructType().add("key", "string").add("number", types[number].dataType).add("at", "long").add("attempt", "long").add("action", "string")
    slim = requests.withWatermark(at, late).select(F.col(at).alias("at"), F.col(key).cast("string").alias("key"), F.col(number).alias("number"), F.unix_micros(at).alias("us"), F.col(succeeded).alias("ok"), bucket_of(key, buckets).alias("bucket"))
    made = slim.groupBy("bucket").applyInPandasWithState(attempts_of(1000 * wait), schema, "held string", "append", "EventTimeTimeout")
    return made.select(F.col("key").cast(types[key].dataType).alias(key), F.col("number").alias(number), F.timestamp_millis("at").alias("at"), "attempt", "action")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an appending stream over all that is there, and return all that it has appended."""
    stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path, format="parquet").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
