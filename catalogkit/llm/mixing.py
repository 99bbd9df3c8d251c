"""Mixing sources to target weights: Efraimidis-Spirakis sampling, DataFrame functions only.

Each source gets a share of all words by its weight, at most ``cap`` times its own
size (the excess is shared again by weight). Complete passes over a source come first;
the rest of its target is a weighted sample without replacement: documents in
descending order of u ** (1 / quality), u uniform by a hash of the identifier, taken
until the target is reached. The document at the limit gives the words still missing.

The order within a source is never sorted as one group, and no source is one task: sizes are
summed by ranges of the key, the range that holds the limit is cut into ranges again until
it has few rows, and only these are sorted. Rows meet their source's limits by broadcast
while sources are at most ``MANY``, else in a join salted by the identifier.

Defined results: a null text has size 0 and is taken 0 times; sources sort by code
point with null last; an empty table gives no rows; rows equal in identifier and size
share one place in the order and what is left for it. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalogkit.llm.common import free, stored, words

SEED = "mix"
MANY, SALTS, PASSES = 50_000, 64, 12


def quality(ws: Column) -> Column:
    """Weight of a document from its words: their distinct share, 0.1 at least."""
    return F.when(F.size(ws) == 0, 1.0).otherwise(F.greatest(F.lit(0.1), F.size(F.array_distinct(ws)) / F.size(ws)))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform in (0, 1) by the identifier, from 52 bits of its md5."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    """All columns, then ``__size`` (words) and ``__v`` (the sampling key)."""
    with_words = docs.withColumn("__ws", words(F.col(text)))
    return with_words.select(*docs.columns, F.size("__ws").cast("long").alias("__size"), F.pow(uniform(F.col(doc_id), seed), 1 / quality(F.col("__ws"))).alias("__v"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``source``, ``source_size`` -> the same with ``target``; one row for each source.

    The level at which capped shares add up to the total is the largest of the levels
    reached when the sources most short of words are capped first, one by one."""
    everything, by_need = W.partitionBy(), W.partitionBy().orderBy("need", "rank")
    s = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1))
    s = s.withColumn("need", F.lit(cap) * F.col("source_size") / F.col("weight"))
    capped = F.lit(cap) * (F.sum("source_size").over(by_need.rowsBetween(W.unboundedPreceding, 0)) - F.col("source_size"))
    open_weight = F.sum("weight").over(by_need.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - capped) / open_weight)
    level = F.max("level").over(everything)
    return s.select("source", "source_size", F.least((F.lit(cap) * F.col("source_size")).cast("double"), level * F.col("weight")).alias("target"))


def with_source(rows: DataFrame, by_source: DataFrame, doc_id: str, source: str, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with the row of their source in ``by_source``, and no source in one task."""
    same = F.col(source).eqNullSafe(F.col(key))
    if by_source.limit(MANY + 1).count() <= MANY:
        return rows.join(F.broadcast(by_source), same, how)
    salted = by_source.withColumn("__s1", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("__s2", F.pmod(F.xxhash64(doc_id, "__v"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, same & (F.col("__s1") == F.col("__s2")), how).drop("__s1", "__s2")


def limits(slim: DataFrame, doc_id: str = "doc_id", source: str = "source", ranges: int = 256, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, few: int = 20_000) -> DataFrame:
    """For each source: target, full passes, and the place in its order where the last,
    partial pass ends (``cut_v``, ``cut_id``, ``cut_size``, words ``left`` for it)."""
    # the fifth root spreads keys of small quality; a larger one comes earlier
    rows = slim.select(F.col(source).alias("source"), F.col(doc_id).alias("id"), "__size", "__v", (1 - F.pow("__v", F.lit(0.2))).alias("g"))
    aims = targets(rows.groupBy("source").agg(F.sum("__size").alias("source_size")), weights, cap)
    aims = aims.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    aims = stored(aims.withColumn("rest", F.floor(F.col("target") - F.col("passes") * F.col("source_size") + 0.5)))
    # the range of g that holds the limit (both bounds are in it), and the words before it
    at = aims.where("rest > 0").select(F.col("source").alias("s"), "rest", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("n"))
    within = F.col("g").between(F.col("low"), F.col("high"))
    for _ in range(PASSES):
        part = F.least(F.lit(ranges - 1), F.floor((F.col("g") - F.col("low")) / (F.col("high") - F.col("low")) * ranges))
        inside = with_source(rows, at.where(F.col("n").isNull() | (F.col("n") > few)), "id", "source", "s").where(within)
        by_range = inside.groupBy("s", "rest", "before", part.alias("part")).agg(F.sum("__size").alias("words"), F.count_if(F.col("__size") > 0).alias("rows"), F.min("g").alias("first"), F.max("g").alias("last"))
        before = F.col("before") + F.sum("words").over(W.partitionBy("s").orderBy("part")) - F.col("words")
        found = by_range.withColumn("before", before).where("before < rest and before + words >= rest")
        nearer = found.select("s", "rest", F.col("first").alias("low"), F.col("last").alias("high"), "before", F.when(F.col("first") < F.col("last"), F.col("rows")).otherwise(0).alias("n"))
        at, last = stored(nearer.unionByName(at.where(F.col("n") <= few))), at
        free(last)
        if at.where(F.col("n") > few).isEmpty():
            break
    edge = with_source(rows.where("__size > 0"), at, "id", "source", "s").where(within)
    edge = edge.groupBy("s", "before", "rest", "__v", "id", "__size").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("s").orderBy(F.col("__v").desc(), F.col("id").asc_nulls_last(), "__size")
    edge = edge.withColumn("upto", F.col("before") + F.sum(F.col("__size") * F.col("n")).over(order))
    edge = edge.where("upto >= rest and upto - __size * n < rest")
    cut = edge.select("s", F.col("__v").alias("cut_v"), F.col("id").alias("cut_id"), F.col("__size").alias("cut_size"), F.floor((F.col("rest") - F.col("upto") + F.col("__size") * F.col("n")) / F.col("n")).alias("left"))
    names = ("source", "source_size", "target", "passes", "rest", "cut_v", "cut_id", "cut_size", "left")
    return stored(aims.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(*(F.col(c).alias(f"__{c}") for c in names)))


def apply_limits(rows: DataFrame, ends: DataFrame, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """Measured rows with their source's columns of ``ends``, ``__partial`` (words of the
    last pass) and ``__taken`` (all words, repeats counted)."""
    v, key, n = F.col("__v"), F.col(doc_id), F.col("__size")
    tied = v == F.col("__cut_v")
    later = F.when(F.col("__cut_id").isNull(), key.isNotNull()).otherwise(key < F.col("__cut_id"))
    same = key.eqNullSafe(F.col("__cut_id"))
    part = F.when((F.col("__rest") <= 0) | F.col("__cut_v").isNull(), 0).when((v > F.col("__cut_v")) | (tied & (later | (same & (n < F.col("__cut_size"))))), n).when(tied & same & (n == F.col("__cut_size")), F.col("__left")).otherwise(0)
    joined = with_source(rows, ends, doc_id, source, "__source")
    return joined.withColumn("__partial", part.cast("long")).withColumn("__taken", (F.col("__passes") * n + F.col("__partial")).cast("long"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options: object) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: a document comes once for each
    full pass; the partial pass adds it again (the one at the limit cut to its first
    words, joined by one space)."""
    rows = measured(docs, doc_id, text)
    slim = stored(rows.select(doc_id, source, "__size", "__v"))
    ends = limits(slim, doc_id, source, **options)
    free(slim)
    chosen = apply_limits(rows, ends, doc_id, source).where("__taken > 0")
    full = F.transform(F.sequence(F.lit(1), F.col("__passes").cast("int")), lambda _: F.col("__size"))
    runs = F.concat(F.when(F.col("__passes") > 0, full).otherwise(F.array().cast("array<bigint>")), F.when(F.col("__partial") > 0, F.array("__partial")).otherwise(F.array().cast("array<bigint>")))
    out = chosen.withColumn("__n", F.explode(runs))
    cut = F.array_join(F.slice(words(F.col(text)), 1, F.col("__n").cast("int")), " ")
    return out.withColumn(text, F.when(F.col("__n") < F.col("__size"), cut).otherwise(F.col(text))).select(*docs.columns)


ORACLE = rf"""
WITH w AS (SELECT doc_id, source, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
d AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) size,
        pow((CAST(concat('0x', substr(md5(concat('{SEED}', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0,
            1 / CASE WHEN len(ws) = 0 THEN 1.0 ELSE greatest(0.1, CAST(len(list_distinct(ws)) AS DOUBLE) / len(ws)) END) v FROM w),
s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
n AS (SELECT *, rk % 3 + 1 AS weight, 3.0 * source_size / (rk % 3 + 1) AS need FROM s),
l AS (SELECT *, (sum(source_size) OVER () - 3 * (sum(source_size) OVER (ORDER BY need, rk) - source_size)) / sum(weight) OVER (ORDER BY need DESC, rk DESC) AS lv FROM n),
t AS (SELECT source, source_size, least(3.0 * source_size, max(lv) OVER () * weight) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
b AS (SELECT *, floor(target - passes * source_size + 0.5) AS rest FROM e),
c AS (SELECT d.*, b.source_size, b.target, b.passes, b.rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.v DESC, d.doc_id NULLS LAST, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(passes * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM c"""
