"""Multiple-choice items: seeded orders, tiered distractors, balanced rounds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from catalogkit.functions import fixed


def hash_order(seed: Column | str, key: Column) -> Column:
    """A repeatable order: the md5 of seed and key."""
    return F.md5(F.concat_ws("#", F.lit(seed) if isinstance(seed, str) else seed, key.cast("string")).cast("binary"))


def lcg_permutation(n: Column, seed: Column) -> Column:
    """Indexes 0..n-1 as a Fisher-Yates shuffle driven by a 32-bit linear congruential
    generator leaves them (seed 0 stands for 123456789)."""
    steps = F.when(n > 1, F.sequence(n.cast("int") - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: i).alias("p"), F.when(seed == 0, 123456789).otherwise(seed).cast("long").alias("s"))

    def step(acc: Column, i: Column) -> Column:
        s = (acc["s"] * F.lit(1664525).cast("long") + F.lit(1013904223).cast("long")).bitwiseAND(F.lit(4294967295).cast("long"))
        j = (s % (i + 1)).cast("int")
        swapped = F.transform(acc["p"], lambda x, k: F.when(k == i, F.get(acc["p"], j)).when(k == j, F.get(acc["p"], i)).otherwise(x))
        return F.struct(swapped.alias("p"), s.alias("s"))

    return F.aggregate(steps, start, step, lambda acc: acc["p"])


def lcg_draws(n: int, seed: int) -> np.ndarray:
    """The swaps of a shuffle of n by the same generator: the partner of n - 1, n - 2, ..., 1.

    The m-th state is a**m * seed + c * (1 + a + ... + a**(m - 1)), so all come at once, from running products and
    sums modulo 2**32."""
    steps = max(n - 1, 0)
    powers = np.cumprod(np.full(steps, 1664525, np.uint32), dtype=np.uint32)
    sums = np.cumsum(np.concatenate([np.ones(min(steps, 1), np.uint32), powers[:-1]]), dtype=np.uint32)
    states = powers * np.uint32(seed or 123456789) + sums * np.uint32(1013904223)
    return (states % np.arange(n, 1, -1, dtype=np.uint32)).astype(np.int64) if steps else np.zeros(0, np.int64)


def lcg_shuffle(df: DataFrame, by: str, key: str, seed: Column) -> DataFrame:
    """Every row with its ``place`` (from 1) in its group, whose rows in order of ``key`` are shuffled as
    ``lcg_permutation`` does; ``seed`` is that of the group's first row. Rows of one key keep any order.

    The swaps depend on one another, so that a group is one task, which holds its keys and places, and takes time in
    proportion to them."""
    schema = StructType([*df.schema.fields, StructField("place", LongType())])

    def shuffle(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(key, kind="stable")
        order = list(range(len(b)))
        for i, j in zip(range(len(b) - 1, 0, -1), lcg_draws(len(b), int(b["__seed"].iloc[0])).tolist()):
            order[i], order[j] = order[j], order[i]
        return b.iloc[order].drop(columns="__seed").assign(place=np.arange(1, len(b) + 1))

    return df.withColumn("__seed", seed.cast("long")).groupBy(by).applyInPandas(shuffle, schema)


def distractors(entities: DataFrame, entity: str, tiers: tuple[str | None, ...], need: int = fixed.OPTION_COUNT - 1, seed: str = "ring", digits: int = 3) -> DataFrame:
    """``need`` other entities for each: from its group, then its category, then all.

    In each tier the entities stand on a ring in hash order, and an answer sees only the
    next ``need`` after it: that is enough, as a later tier must replace at most those
    already taken. Positions are found by ranges of the hash (its first ``digits`` hexadecimal ones), so that a
    tier of all entities is not sorted as one group; at most ``need`` rows a tier come for each entity. All
    tiers go through one plan, each entity once for each.

    The joins are hinted: Spark would take the size of a small file for that of the ring and broadcast it whole."""
    groups = F.array(*(F.struct(F.lit(no).alias("tier"), (F.col(by).cast("string") if by else F.lit("")).alias("g")) for no, by in enumerate(tiers)))
    ring = entities.select(F.col(entity), hash_order(seed, F.col(entity)).alias("h"), F.explode(groups).alias("x")).select(entity, "h", "x.tier", "x.g").where("g is not null")
    ring = ring.withColumn("b", F.substring("h", 1, digits))
    sizes = ring.groupBy("tier", "g", "b").agg(F.count(F.lit(1)).alias("m"))
    whole = W.partitionBy("tier", "g")
    before = sizes.select("tier", "g", "b", (F.sum("m").over(whole.orderBy("b")) - F.col("m")).alias("before"), F.sum("m").over(whole).alias("n"))
    ring = ring.withColumn("r", F.row_number().over(W.partitionBy("tier", "g", "b").orderBy("h")) - 1).join(before.hint("merge"), ["tier", "g", "b"])
    ring = ring.select(entity, "tier", "g", "n", (F.col("before") + F.col("r")).alias("r"))
    asked = ring.where("n > 1").select(F.col(entity).alias("answer"), "tier", "g", F.explode(F.sequence(F.lit(1), F.least(F.lit(need), F.col("n").cast("int") - 1))).alias("d"), "r", "n")
    asked = asked.select("answer", "tier", "g", "d", ((F.col("r") + F.col("d")) % F.col("n")).alias("r"))
    found = asked.join(ring.select("tier", "g", "r", F.col(entity).alias("option")).hint("merge"), ["tier", "g", "r"]).select("answer", "option", (F.col("tier") * (need + 1) + F.col("d")).alias("at"))
    first = found.groupBy("answer", "option").agg(F.min("at").alias("at")).select("answer", "option", F.floor(F.col("at") / (need + 1)).cast("int").alias("tier"), (F.col("at") % (need + 1)).alias("d"))
    return first.withColumn("pick", F.row_number().over(W.partitionBy("answer").orderBy("tier", "d"))).where(F.col("pick") <= need)


def item_bank(entities: DataFrame, entity: str, group: str, category: str, types: tuple[str, ...] = ("logo_to_brand", "brand_to_logo"), seed: str = "ring") -> DataFrame:
    """Two items for each entity with four options: ``item_id``, type, answer, options in a
    seeded order, group and category."""
    chosen = distractors(entities, entity, (group, category, None), seed=seed).groupBy("answer").agg(F.collect_list("option").alias("others"))
    full = entities.join(chosen.where(F.size("others") == fixed.OPTION_COUNT - 1).hint("merge"), F.col(entity) == F.col("answer"))
    options = F.transform(F.array_sort(F.transform(F.concat(F.array(F.col(entity)), "others"), lambda o: F.named_struct(F.lit("h"), hash_order(F.col(entity).cast("string"), o), F.lit("option"), o))), lambda x: x["option"])
    kinds = F.explode(F.array(*map(F.lit, types))).alias("type")
    return full.select(F.col(entity).alias("answer"), kinds, options.alias("options"), F.col(group).alias("item_group"), F.col(category).alias("category")).withColumn("item_id", F.concat_ws("_", "type", F.col("answer").cast("string")))


def sample_items(items: DataFrame, n: int, seed: str, item: str = "item_id") -> DataFrame:
    """n items in a seeded order."""
    return items.orderBy(hash_order(seed, F.col(item)), item).limit(n)


def balanced_pick(items: DataFrame, n: int, seed: str, bucket: str = "category", item: str = "item_id", answer: str = "answer", taken: DataFrame | None = None) -> DataFrame:
    """n items, round-robin over the buckets: ``turn`` is an item's turn in its bucket.

    Each answer comes once, with the first of its items in the seeded order, and those of ``taken``
    not at all. Where that gives fewer than n, items not picked yet fill up, whatever their answer;
    their turn is null."""
    pool = items if taken is None else items.join(taken.select(answer).distinct(), answer, "left_anti")
    at = hash_order(seed, F.col(item))
    once = pool.groupBy(answer).agg(F.min_by(F.struct(*items.columns), F.struct(at, item)).alias("r")).select("r.*")
    turns = once.withColumn("turn", F.row_number().over(W.partitionBy(bucket).orderBy(at, item))).where(F.col("turn") <= n)
    first = turns.orderBy("turn", hash_order(seed, F.col(bucket)), bucket).limit(n)
    more = items.join(first.select(item), item, "left_anti").orderBy(at, item).limit(n)
    both = first.unionByName(more.withColumn("turn", F.lit(None).cast("int")))
    return both.orderBy(F.col("turn").asc_nulls_last(), F.when(F.col("turn").isNull(), at).otherwise(hash_order(seed, F.col(bucket))), bucket, item).limit(n)


def mixed_pick(items: DataFrame, n: int, seed: str, first: str, second: str, entity: str = "answer") -> DataFrame:
    """ceil(n / 2) items of one type and the rest of the other, no entity twice, interleaved."""
    half = (n + 1) // 2
    a = balanced_pick(items.where(F.col("type") == first), half, seed)
    b = balanced_pick(items.where(F.col("type") == second), n - half, seed, taken=a)
    place = W.orderBy("turn", hash_order(seed, F.col("category")), "category")
    parts = [x.withColumn("place", F.row_number().over(place)).withColumn("type_no", F.lit(k)) for k, x in enumerate((a, b))]  # at most n rows
    return reduce(DataFrame.unionByName, parts)


def with_names(items: DataFrame, entities: DataFrame, entity: str, name: str) -> DataFrame:
    """Items with their options as (position, letter, id, name, correct), by one join."""
    placed = items.select("item_id", "answer", F.posexplode("options").alias("pos", "option"))
    named = placed.join(entities.select(F.col(entity).alias("option"), F.col(name).alias("option_name")).hint("merge"), "option", "left")
    letter = F.chr(F.lit(65) + F.col("pos"))
    one = F.struct("pos", letter.alias("letter"), "option", "option_name", (F.col("option") == F.col("answer")).alias("correct"))
    return named.groupBy("item_id", "answer").agg(F.array_sort(F.collect_list(one)).alias("options"))


def item_risks() -> Column:
    """Names of the risks of an item whose options have names."""
    names, answer = F.transform("options", lambda o: F.lower(o["option_name"])), F.get(F.transform(F.filter("options", lambda o: o["correct"]), lambda o: o["option_name"]), F.lit(0))
    checks = [
        ("same_names", F.size(F.array_distinct(names)) != F.size(names)), ("no_answer", ~F.exists("options", lambda o: o["correct"])),
        ("role_suffix", answer.rlike(r"(?i)[-_](icon|logo)\b")), ("id_like", answer.rlike("(?i)^[a-z0-9_]{12,}$")),
    ]
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks)), lambda x: x.isNotNull())


def item_images(image: Callable[[Column], Column]) -> Column:
    """The images that an item shows: those of all options if one picks an image for a name, else that of the answer."""
    return F.when(F.col("type") == "brand_to_logo", F.transform("options", image)).otherwise(F.array(image(F.col("answer"))))


def item_checks(known: Column, name: Column, urls: Column, prefix: str, suffix: str = ".jpg") -> list[tuple[str, Column]]:
    """The rules of an item, in the order in which its errors are given. ``urls``: an array of all images that the item
    shows, the question's or those of its options; a missing one is an error."""
    return [
        ("invalid_type", F.col("type").isin(*fixed.ITEM_TYPES)), ("answer_missing", known), ("option_count_not_4", F.size("options") == fixed.OPTION_COUNT),
        ("duplicate_options", F.size(F.array_distinct("options")) == F.size("options")), ("answer_not_in_options", F.array_contains("options", F.col("answer"))),
        ("invalid_url", F.forall(urls, lambda u: F.coalesce(u.startswith(prefix) & u.endswith(suffix), F.lit(False)))), ("blank_name", F.trim(name) != ""),
    ]


def is_valid_item() -> Column:
    """Fit to be served: a known type, an answer among four different options or more."""
    return F.col("type").isin("logo_to_brand", "brand_to_logo") & F.col("answer").isNotNull() & (F.size("options") >= fixed.OPTION_COUNT) & F.array_contains("options", F.col("answer")) & (F.size(F.array_distinct("options")) == F.size("options"))
