"""Counts, coverage, budgets, response statistics and ranked reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalogkit.functions import fixed, keys


def count_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def counts_side_by_side(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Counts by each column, in one pass: ``facet``, ``value``, ``n``."""
    sets = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).groupingSets([[F.col(c)] for c in columns], *map(F.col, columns))
    counted = sets.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    n = len(columns)
    which = [(2**n - 1) ^ (1 << (n - 1 - i)) for i in range(n)]  # the bit of the grouped column is 0
    facet, value = F, F
    for c, g in zip(columns, which):
        facet, value = facet.when(F.col("g") == g, F.lit(c)), value.when(F.col("g") == g, F.col(c))
    return counted.select(facet.alias("facet"), value.alias("value"), "n")


def first_in_group(df: DataFrame, by: str, k: int, fields: tuple[str, ...], name: str) -> DataFrame:
    """``by`` and ``name``: the first k rows of each group in order of ``fields``, as structs, or as plain values of one field. What
    is gathered for a group is never more."""
    value = F.struct(*fields) if len(fields) > 1 else F.col(fields[0])
    first = top_k_by(df.select(by, *(c for c in fields if c != by)), by, k, *map(F.col, fields))
    return first.groupBy(by).agg(F.array_sort(F.collect_list(value)).alias(name))


def with_first(df: DataFrame, lists: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` with the group's list from ``first_in_group``; an empty one for groups without rows."""
    named = lists.withColumnRenamed(by, "__by")
    return df.join(named, F.col(by).eqNullSafe(F.col("__by")), "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType))).drop("__by")


def coverage(entities: DataFrame, candidates: DataFrame, entity: str, group: str, approved: Column) -> DataFrame:
    """By group: entities, those with a candidate and with an approved one, how many are missing and all of these in order,
    ratio."""
    per = candidates.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.max(approved.cast("int")).alias("ok"))
    joined = entities.select(entity, group).join(per, entity, "left")
    out = joined.groupBy(group).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("n") > 0).alias("covered"), F.count_if(F.col("ok") == 1).alias("approved"), F.count_if(F.col("n").isNull()).alias("missing_count"),
        F.array_sort(F.collect_list(F.when(F.col("n").isNull(), F.col(entity)))).alias("missing"),
    )
    return out.withColumn("ratio", F.floor(F.col("covered") / F.col("total") * 1000 + 0.5) / 1000).withColumn("playable", F.col("approved") >= fixed.GROUP_MINIMUM)


def collection_report(entities: DataFrame, candidates: DataFrame, entity: str, error: Column) -> DataFrame:
    """For each entity the number of its candidates and of their errors (``error``: a text, or null), and all errors in order."""
    known = entities.select(entity).distinct()
    counted = candidates.groupBy(entity).agg(F.count(F.lit(1)).alias("candidates"), F.count(error).alias("error_count"), F.array_sort(F.collect_list(error)).alias("errors"))
    out = known.join(counted, entity, "left")
    return out.select(entity, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("candidates", "error_count")), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))


def budget(df: DataFrame, size: str, limit: int, planned: int = 300) -> DataFrame:
    """Total and average size, what ``planned`` items would take, and whether a limit is passed."""
    out = df.agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("total"))
    out = out.withColumn("average", F.when(F.col("files") > 0, keys.half_up(F.col("total") / F.col("files"))).otherwise(0)).withColumn("projected", F.col("average") * planned)
    return out.withColumn("over", F.col("total") > limit).withColumn("projected_over", F.col("projected") > limit)


def percent(correct: Column, total: Column) -> Column:
    return F.when(total > 0, keys.half_up(correct / total * 100)).otherwise(0)


def group_stats(answers: DataFrame, by: str, correct: str = "correct", latency: str = "latency", default: str = fixed.DEFAULT_GROUP) -> DataFrame:
    """By group: answers, correct ones, accuracy in percent and mean latency."""
    named = answers.withColumn(by, keys.first_filled(F.col(by), F.lit(default)))
    out = named.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(correct).alias("correct"), F.sum(latency).alias("t"))
    return out.select(by, "total", "correct", percent(F.col("correct"), F.col("total")).alias("accuracy"), keys.half_up(F.col("t") / F.col("total")).alias("mean_latency"))


def core_metrics(answers: DataFrame, label: str, correct: str = "correct", latency: str = "latency", order: str = "ord") -> DataFrame:
    """Fastest correct and slowest answer with their labels; the first of equal ones."""
    first = F.struct(latency, order)
    slow = F.struct((-F.col(latency)).alias("l"), order)
    return answers.agg(
        F.min(F.when(F.col(correct), F.col(latency))).alias("fastest"), F.min_by(label, F.when(F.col(correct), first)).alias("fastest_label"),
        F.max(latency).alias("slowest"), F.min_by(label, slow).alias("slowest_label"),
    )


def insights(stats: DataFrame, by: str, least: int = 4, weak: int = 60, top: int = 6) -> DataFrame:
    """Groups with enough answers: the ``top`` by accuracy, then count, and which of them is best,
    weakest (only below ``weak``) and fastest."""
    s = stats.where(F.col("total") >= least)
    order = [F.col("accuracy").desc(), F.col("total").desc(), F.col(by)]
    picks = s.agg(F.min_by(by, F.struct((-F.col("accuracy")).alias("a"), (-F.col("total")).alias("t"), by)).alias("best"), F.min_by(by, F.struct("accuracy", by)).alias("low"), F.min("accuracy").alias("lowest"), F.min_by(by, F.struct("mean_latency", by)).alias("fast"))
    chosen = s.orderBy(*order).limit(top).join(F.broadcast(picks))  # one row of picks
    return chosen.select(by, "total", "accuracy", (F.col(by) == F.col("best")).alias("is_best"), ((F.col(by) == F.col("low")) & (F.col("lowest") < weak)).alias("is_weakest"), (F.col(by) == F.col("fast")).alias("is_fastest"))


def session_totals(answers: DataFrame, session: str, correct: str = "correct") -> DataFrame:
    """One row for each session: total, score and accuracy."""
    out = answers.groupBy(session).agg(F.count(F.lit(1)).alias("total"), F.count_if(correct).alias("score"))
    return out.withColumn("accuracy", percent(F.col("score"), F.col("total")))


def sessions(answers: DataFrame, session: str, fields: tuple[str, ...], correct: str = "correct", most: int = 1_000) -> DataFrame:
    """One row for each session: total, score, accuracy and its first ``most`` records in order."""
    return with_first(session_totals(answers, session, correct), first_in_group(answers, session, most, fields, "records"), session, "records")


def running_sums(df: DataFrame, by: str, order: str, sums: dict[str, Column], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All columns, then ``n`` (the row's number in its group), ``total`` (rows of the group) and for each name of ``sums``
    the sum up to the row; ``order`` tells the rows of a group apart.

    Rows are dealt by ranges of group and order, so that a long group is spread over tasks. Sums run within each range; what
    the ranges of the group before hold is added (one row for each group and range). ``keep`` stores
    the dealt table, so that ranges stay what they are."""
    dealt = keep(df.withColumns({f"__{name}": value for name, value in sums.items()}).repartitionByRange(by, order).withColumn("__range", F.spark_partition_id()))
    within, before = W.partitionBy(by, "__range").orderBy(order).rowsBetween(W.unboundedPreceding, 0), W.partitionBy(by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    parts = dealt.groupBy(by, "__range").agg(F.count(F.lit(1)).alias("__m"), *(F.sum(f"__{name}").alias(f"__{name}") for name in sums))
    upto = {"__m": "__n0", **{f"__{name}": f"__{name}0" for name in sums}}
    parts = parts.select(F.col(by).alias("__by"), F.col("__range").alias("__at"), F.sum("__m").over(W.partitionBy(by)).alias("total"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(to) for c, to in upto.items()))
    local = dealt.withColumn("n", F.count(F.lit(1)).over(within)).withColumns({name: F.coalesce(F.sum(f"__{name}").over(within), F.lit(0)) for name in sums})
    joined = local.join(parts, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__range") == F.col("__at")))
    joined = joined.withColumns({"n": F.col("n") + F.col("__n0"), **{name: F.col(name) + F.col(f"__{name}0") for name in sums}})
    return joined.select(*(c for c in df.columns if c not in ("n", "total", *sums)), "n", "total", *sums)


def running_score(answers: DataFrame, session: str, order: str, keep: Callable[[DataFrame], DataFrame], correct: str = "correct") -> DataFrame:
    """Score so far and progress in percent, answer by answer; a session may be of any length."""
    summed = running_sums(answers, session, order, {"score": F.col(correct).cast("long")}, keep)
    return summed.withColumn("progress", keys.half_up(F.col("n") / F.col("total") * 100)).drop("total")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_by(df: DataFrame, by: str, k: int, *order: Column, parts: int = 64) -> DataFrame:
    """The first k rows of each group, with their ``rank``.

    Of few rows each task picks its first k of a group before the shuffle (Spark's group limit). Beyond its threshold
    the rows of a group are dealt to ``parts`` by a hash of the whole row, which pick first."""
    first = lambda rows, *of: rows.withColumn("rank", F.row_number().over(W.partitionBy(*of).orderBy(*order))).where(F.col("rank") <= k)
    if k <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        return first(df, by)
    part = F.pmod(F.xxhash64(*(c for c in df.columns if not df.schema[c].dataType.typeName() == "map")), F.lit(parts))
    return first(first(df.withColumn("__part", part), by, "__part").drop("rank", "__part"), by)


def ranked_by(df: DataFrame, by: str, order: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows of each group with their ``rank``; a long group is spread over tasks."""
    return running_sums(df, by, order, {}, keep).drop("total").withColumnRenamed("n", "rank")


def conversion_report(resources: DataFrame, group: str, status: Column, size: Column, matches: DataFrame, large: int = fixed.LARGE_FILE) -> DataFrame:
    """Converted, failed and large files of each group, with the group's ``matched`` (0 without any)."""
    counted = resources.groupBy(group).agg(
        F.count_if(status == "converted").alias("converted"), F.count_if(status != "converted").alias("failed"), F.count_if((status == "converted") & (size > large)).alias("large_files")
    )
    return counted.join(matches.select(group, "matched"), group, "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
