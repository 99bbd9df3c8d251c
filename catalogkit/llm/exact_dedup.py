"""Exact dedup as a stateful stream.

A stream over the document files keeps state for each digest of the normalised text
(A-Z lower-cased, UTF-8, SHA-256), on disk (RocksDB state store) and without expiry:
how many rows had it, the largest identifier among them (the row that stays) and where
that row's content lies. The state is then read as a table. Where a digest was seen
more than once, full texts are compared: rows are grouped by the text itself, with
map-side combining, so that a digest shared by different texts is told apart.

A digest that more than a thousandth of all rows have is hot; there are fewer than a
thousand, so they are broadcast, and their rows are dealt out one by one in joins.

The stream runs over what is there (``availableNow``); started again over the same
checkpoint it takes in new files only.

Defined results: a null text counts as empty. A null identifier is smaller than any
other. Rows equal in identifier and text are members of one group each; the row that
stays is then each of those with the largest identifier. An empty table gives no rows.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogkit.llm.common import ascii_lower, shared_dir, stored
from catalogkit.sources.files import stream_parquet

#: A digest is hot if it has more than this share (1 / MOST_HOT) of all rows.
MOST_HOT = 1_000
#: State on disk; the logs of changes go to the checkpoint, and no disk is reserved ahead.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@contextmanager
def disk_backed_state(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keyed_state(stream: DataFrame, checkpoint: str, doc_id: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """Run the stream to its end; the state it holds then, one row for each digest."""
    spark = stream.sparkSession
    rows = stream.select(digest(normalised(F.col(text))).alias("digest"), F.col(doc_id).alias("id"), F.col("_metadata.file_path").alias("file"))
    # the locator is the file of the row that stays; struct order puts the identifier first
    state = rows.groupBy("digest").agg(F.max(F.struct("id", "file")).alias("kept"), F.count(F.lit(1)).alias("n"))
    with disk_backed_state(spark):
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.format("statestore").option("path", checkpoint).load()


def deduplicate(spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text", checkpoint: str | None = None, digest=sha256) -> DataFrame:
    """Every row of the Parquet table at ``path``: ``doc_id``, ``digest``, ``keep_id``,
    ``group_size`` and ``locator``, the file of the row that stays."""
    held = keyed_state(stream_parquet(spark, path), checkpoint or shared_dir(spark), doc_id, text, digest)
    kept, n = (held["value"][name] for name in held.schema["value"].dataType.names[:2])
    held = stored(held.select("key.digest", F.struct(kept["id"].alias("keep_id"), n.alias("group_size"), kept["file"].alias("locator")).alias("group")))
    rows = spark.read.parquet(path).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"), F.col("_metadata.file_path").alias("__file"))
    rows = rows.withColumn("__norm", normalised(F.col("__text"))).withColumn("digest", digest(F.col("__norm")))

    # rows of a hot digest get its group by broadcast, and a key of their own in the joins by digest
    total = held.agg(F.sum("group.group_size")).first()[0] or 0
    hot = held.where(F.col("group.group_size") > max(1, total / MOST_HOT)).select(F.col("digest").alias("__hot"), F.col("group").alias("__group"))
    rows = rows.join(F.broadcast(hot), F.col("digest") == F.col("__hot"), "left")
    rows = rows.withColumn("__key", F.when(F.col("__hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("row "), F.monotonically_increasing_id())))

    # both joins shuffle at every size: what they meet grows with the input
    often = held.where("group.group_size > 1").select(F.col("digest").alias("__often"))
    hits = rows.join(often.hint("merge"), F.col("__key") == F.col("__often"), "left").where("__often is not null or __hot is not null")
    texts = hits.groupBy("digest", "__norm").agg(F.max(F.struct("doc_id", "__file")).alias("last"), F.count(F.lit(1)).alias("n"))
    mixed = stored(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"))

    plain = rows.select("doc_id", "digest", "__key", "__group").join(held.withColumnRenamed("digest", "__key").hint("merge"), "__key", "left")
    plain = plain.select("doc_id", "digest", F.coalesce("__group", "group").alias("group")).select("doc_id", "digest", "group.*")
    if mixed.isEmpty():
        return plain
    # some digest stands for several texts: there the text decides
    others = texts.join(mixed, "digest").select(F.col("__norm").alias("__other"), F.col("last.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("last.__file").alias("locator"))
    apart = rows.join(mixed, "digest", "left_semi").join(others, F.col("__norm") == F.col("__other"))
    return plain.join(mixed, "digest", "left_anti").unionByName(apart.select("doc_id", "digest", "keep_id", "group_size", "locator"))
