"""A corpus pipeline: each stage applies one operator to all that its predecessor kept.

quality rules -> line dedup -> MinHash near-dedup -> source mixing -> packing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogkit.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from catalogkit.llm.common import SPACE, free, small_side, stored, table
from catalogkit.llm.queries import tokenizer_path


def keep_by_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest let pass."""
    labels = table(spark, sf_dir, "labels")
    ids = small_side(stored(labels.where("quality in (0, 1)").select(F.col("doc_id").alias("__id")).distinct()), 1_000_000)
    labelled = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id"), "left_semi")  # nothing else is measured for the model
    model = quality_rules.train(quality_rules.with_stats(labelled, keep=(F.col("doc_id"),)), labels)
    stats = quality_rules.with_stats(docs, keep=tuple(F.col(c).alias(f"col_{c}") for c in docs.columns), forest=model[0])
    return quality_rules.judge(stats, model).where("kept").select(*(F.col(f"col_{c}").alias(c) for c in docs.columns))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines whose templates recur; a document of which nothing is
    left goes, and ``n_chars`` follows the text."""
    left = line_dedup.deduplicate(docs, wide=True)
    left = left.where((F.col("n_dropped") == 0) | F.regexp_like(F.coalesce("text", F.lit("")), F.lit(SPACE.replace("[", "[^", 1))))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest identifier of each group of near copies, once if its row is
    repeated. Rows without an identifier stay once for each set of shingles that no other row has."""
    found = stored(near_dedup.groups(docs))
    gone = found.where("id <> component_id").select(F.col("id").alias("__id")).distinct()
    left = docs.join(small_side(gone, 2_000_000), F.col("doc_id") == F.col("__id"), "left_anti")
    repeated = found.groupBy("id").count().where("id is null or count > 1").select(F.col("id").alias("__id"))
    if repeated.isEmpty():
        return left
    again = left.join(repeated, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    once = again.where("doc_id is not null").dropDuplicates(["doc_id"])
    named = found.where("id is not null").select(F.col("digest").alias("__digest")).distinct()
    digests = near_dedup.with_digest(again.where("doc_id is null"), "__digest")
    unnamed = digests.where("__digest is not null").join(named, "__digest", "left_anti").dropDuplicates(["__digest"])
    unnamed = unnamed.unionByName(digests.where("__digest is null"))
    return left.join(repeated, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti").unionByName(once).unionByName(unnamed.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each time that it takes them."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    made = packing.pieces(docs, tokenizer_path(), keep=(F.col("doc_id"),))
    return packing.pack(made).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", keep_by_quality_rules),
    ("line_dedup", drop_recurring_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL expresses neither the forest nor the tokenizer; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        free(before)  # the table of the stage before; the last one goes with the shared folder, as the result reads it
    return STAGES[-1][1](spark, docs, sf_dir)
