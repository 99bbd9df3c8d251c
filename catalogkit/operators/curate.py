"""Best-of picks, canonical and near-duplicate removal, identifiers, perceptual hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalogkit.functions import fixed, keys
from catalogkit.operators.analytics import running_sums


def source_priority(source: Column, asset: Column) -> Column:
    return keys.mapped(source, fixed.SOURCE_PRIORITY, fixed.OTHER_PRIORITY) + F.when(F.coalesce(asset, F.lit("")) != "", fixed.ASSET_BONUS).otherwise(0)


def dedupe_priority(source: Column, title: Column, asset: Column, recommended: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(recommended, fixed.RECOMMENDED_BONUS).otherwise(0) + keys.mapped(source, fixed.DEDUPE_PRIORITY, fixed.OTHER_PRIORITY)
        + F.when((low != "") & ~low.isin("default", "color", "icon"), fixed.TITLE_BONUS).otherwise(0) + F.when(F.coalesce(asset, F.lit("")) != "", fixed.DEDUPE_ASSET_BONUS).otherwise(0)
    )


def best_per(df: DataFrame, key: str, priority: Column, order: tuple[str, ...]) -> DataFrame:
    """One row for each key: the highest priority, on ties the first in order. An
    aggregate with map-side combining, so that a key with many rows is no hot task."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct((-priority).alias("p"), *order)).alias("r")).select(key, "r.*")


def mark_copies(df: DataFrame, key: str, record: str, priority: Column, order: tuple[str, ...], protected: Column) -> DataFrame:
    """``duplicate_of``: the keeper of the row's key, for rows that are neither the keeper nor
    protected. Rows without a key are left alone."""
    keeper = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(record, F.struct((-priority).alias("p"), *order)).alias("__keeper"))
    out = df.join(keeper.withColumnRenamed(key, "__key"), F.col(key) == F.col("__key"), "left")
    return out.withColumn("duplicate_of", F.when((F.col("__keeper") != F.col(record)) & ~F.coalesce(protected, F.lit(False)), F.col("__keeper"))).drop("__key", "__keeper")


def unique_ids(df: DataFrame, base: str, order: tuple[str, ...], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``unique_id``: what a pass over the rows in ``order`` gives, when each takes its base, or the first of ``_2``, ``_3``... after
    it that no row before has taken. A null base stays null. ``order`` tells all rows apart.

    A name like ``x_3`` is wanted by two bases at most: by ``x`` as its third, and by the first row of the base ``x_3``
    itself, a claim, which is good if that row comes before the row of ``x`` that would take the name. Which row that would
    be depends on the good claims below 3 only; so claims are judged anew from one another, all at once, until
    none changes (``keep`` stores them between rounds). Rows are numbered by ranges, no base is one task."""
    at = F.struct(*order)
    rows = df.where(F.col(base).isNotNull()).select(F.col(base).alias("b"), at.alias("at"))
    numbered = keep(running_sums(rows, "b", "at", {}, keep).select("b", "at", F.col("n").alias("j")))
    bases = numbered.where("j = 1").select("b", "at")
    named = bases.select(F.regexp_extract("b", r"^(.*)_([2-9]|[1-9]\d{1,17})$", 1).alias("parent"), F.regexp_extract("b", r"^(.*)_([2-9]|[1-9]\d{1,17})$", 2).try_cast("long").alias("k"), F.col("b").alias("child"), F.col("at").alias("came"))
    named = named.where("k is not null").join(bases.select(F.col("b").alias("parent")), "parent")
    claims = keep(named.withColumn("good", F.lit(True)))
    changed = not claims.isEmpty()
    while changed:
        lost = claims.where("not good").select(F.col("child").alias("parent"), F.lit(2).alias("start"))  # their names begin with the second
        judged = claims.join(lost, "parent", "left").withColumn("start", F.coalesce("start", F.lit(1)))
        before = F.coalesce(F.sum(F.col("good").cast("long")).over(W.partitionBy("parent").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a claim, not a row of data
        judged = judged.withColumn("j", F.col("k") - F.col("start") + 1 - before)
        taker = numbered.select(F.col("b").alias("parent"), "j", F.col("at").alias("taken"))
        judged = judged.join(taker, ["parent", "j"], "left").withColumn("now", F.col("taken").isNull() | (F.col("came") < F.col("taken")))
        after = keep(judged.select("parent", "k", "child", "came", F.col("now").alias("good"), (F.col("now") != F.col("good")).alias("changed")))
        changed = not after.where("changed").isEmpty()
        claims = after.drop("changed")
    first = F.when(F.col("taken"), 2).otherwise(1)
    starts = claims.where("not good").select(F.col("child").alias("b"), F.lit(True).alias("taken"))
    # each good claim within reach lifts the numbers of the rows from some place on by one
    lifts = claims.where("good").join(starts.withColumnRenamed("b", "parent"), "parent", "left").withColumn("i", F.row_number().over(W.partitionBy("parent").orderBy("k")))
    lifts = lifts.select(F.col("parent").alias("b"), (F.col("k") - first + 1 - (F.col("i") - 1)).alias("j"))
    some = numbered.join(lifts.select("b").distinct(), "b", "left_semi")
    stacked = lifts.select("b", F.struct("j", F.lit(0).cast("long").alias("row"), F.monotonically_increasing_id().alias("no")).alias("o"), F.lit(1).alias("lift")).unionByName(some.select("b", F.struct("j", F.lit(1).cast("long").alias("row"), F.lit(0).cast("long").alias("no")).alias("o"), F.lit(0).alias("lift")))
    lifted = running_sums(stacked, "b", "o", {"lifts": F.col("lift")}, keep).where("o.row = 1").select("b", F.col("o.j").alias("j"), "lifts")
    given = numbered.join(lifted, ["b", "j"], "left").join(starts, "b", "left").withColumn("k", F.col("j") + first - 1 + F.coalesce("lifts", F.lit(0)))
    given = given.select(F.col("at").alias("__at"), F.when(F.col("k") == 1, F.col("b")).otherwise(F.concat_ws("_", "b", "k")).alias("unique_id"))
    return df.withColumn("__key", at).join(given, F.col("__key") == F.col("__at"), "left").drop("__key", "__at")


def preferred(available: Column, order: tuple[str, ...] = fixed.PREFERENCE) -> Column:
    """The first name of the order that the array holds."""
    return F.get(F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(available, x)), F.lit(0))


def average_hash(values: Column) -> Column:
    """A bit for each value: whether it is at least the mean. 64 bits a number; the first value is
    the lowest bit of the first one."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  what is bound is computed once
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(values)
    bits = once(mean, lambda m: F.transform(values, lambda x: (x.cast("double") >= m).cast("long")))
    word = lambda part: F.aggregate(F.transform(part, lambda x, i: F.call_function("shiftleft", x, i)), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    words = once(bits, lambda b: F.transform(F.sequence(F.lit(0), F.ceil(F.size(b) / 64).cast("int") - 1), lambda k: word(F.slice(b, k * 64 + 1, 64))))
    return F.when(F.size(values) > 0, words).otherwise(F.array().cast("array<bigint>"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes; hashes of unequal length are as far apart as can be."""
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return F.when(F.size(a) == F.size(b), bits).otherwise(fixed.FAR_APART)


def bounds_ratio(cells: Column, width: int, threshold: float = fixed.CELL_THRESHOLD) -> Column:
    """Width by height of the box around all cells above the threshold; 0 without one."""
    full = F.filter(F.transform(cells, lambda v, i: F.when(v > threshold, i)), lambda i: i.isNotNull())
    x, y = F.transform(full, lambda i: i % width), F.transform(full, lambda i: F.floor(i / width))
    return F.when(F.size(full) == 0, 0.0).otherwise((F.array_max(x) - F.array_min(x) + 1) / (F.array_max(y) - F.array_min(y) + 1))


def hash_classes(df: DataFrame, record: str, code: str) -> DataFrame:
    """Every record with ``class``: the smallest record of the same hash; null for a null hash."""
    first = df.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("__code")).agg(F.min(record).alias("class"))
    return df.select(record, code).join(first, F.col(code) == F.col("__code"), "left").select(record, "class")


def banded_pairs(df: DataFrame, record: str, code: str, distance: int = fixed.HASH_DISTANCE, bits: int = 256, hot: int = 1_000) -> DataFrame:
    """Pairs (a < b) of different hashes of ``bits`` bits within ``distance`` bits, each hash by its smallest record
    (``hash_classes`` tells the others).

    Two hashes that differ in at most ``distance`` bits are equal in one of ``distance`` + 1 bands, so pairs
    come from equi joins on bands, which should be wide: with 4 of 256 bits they have 51. Where more than
    ``hot`` hashes share a band, the bits outside it are cut into ``distance`` + 1 bands again, of which close hashes share one as well."""
    n = distance + 1

    def bands(text: Column, width: int) -> Column:
        cuts = [width * k // n for k in range(n + 1)]
        return F.array(*(F.struct(F.lit(k).alias("band"), F.substring(text, cuts[k] + 1, cuts[k + 1] - cuts[k]).alias("part")) for k in range(n)))

    classes = df.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("code")).agg(F.min(record).alias("id"))
    text = F.array_join(F.transform("code", lambda w: F.lpad(F.bin(w), 64, "0")), "")
    listed = classes.select("id", "code", text.alias("text")).select("id", "code", "text", F.length("text").alias("width"), F.explode(bands(F.col("text"), bits)).alias("x")).select("id", "code", "text", "width", "x.band", "x.part")
    crowded = listed.groupBy("width", "band", "part").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hot).drop("m").withColumn("crowded", F.lit(True))
    marked = listed.join(crowded, ["width", "band", "part"], "left")
    cuts = [bits * k // n for k in range(n + 1)]
    outside = [F.concat(F.substring("text", 1, cuts[k]), F.substring("text", cuts[k + 1] + 1, bits - cuts[k + 1])) for k in range(n)]
    second = F.element_at(F.array(*(bands(outside[k], bits - cuts[k + 1] + cuts[k]) for k in range(n))), F.col("band") + 1)
    none = F.array(F.struct(F.lit(-1).alias("band"), F.lit("").alias("part")))
    split = marked.withColumn("y", F.explode(F.when(F.col("crowded"), second).otherwise(none))).select("id", "code", "width", "band", "part", F.col("y.band").alias("band2"), F.col("y.part").alias("part2"))
    a, b = split.withColumnsRenamed({"id": "a", "code": "ca"}), split.withColumnsRenamed({"id": "b", "code": "cb"})
    near = a.join(b, ["band", "part", "width", "band2", "part2"]).withColumn("distance", hamming(F.col("ca"), F.col("cb"))).where((F.col("a") < F.col("b")) & (F.col("distance") <= distance))
    return near.groupBy("a", "b").agg(F.min("distance").alias("distance"))


def near_copies(df: DataFrame, record: str, code: str, order: Column, protected: Column, keep: Callable[[DataFrame], DataFrame], distance: int = fixed.HASH_DISTANCE, bits: int = 256) -> DataFrame:
    """``id`` and ``state`` (kept, dropped) of every record: what a pass in ``order`` keeps, when a record is dropped if its
    hash is within ``distance`` bits of one kept before; protected records, and those without a hash, are always kept.

    Of the records of one hash the first decides: kept or dropped, all others that are not protected are dropped. So the pass runs over the
    first and the first protected record of each hash, and pairs are those of different hashes, however many copies
    a hash has."""
    rows = keep(df.select(F.col(record).alias("id"), F.col(code).alias("code"), order.alias("o"), F.coalesce(protected, F.lit(False)).alias("safe")))
    at = F.struct("o", "id")
    heads = rows.where(F.col("code").isNotNull()).groupBy("code").agg(F.min("id").alias("class"), F.min_by("id", at).alias("first"), F.min_by("id", F.when(F.col("safe"), at)).alias("first_safe"))
    actors = keep(heads.select("class", F.explode(F.array_distinct(F.array_compact(F.array("first", "first_safe")))).alias("id")).join(rows, "id").select("class", "id", "o", "safe"))
    pairs = keep(banded_pairs(rows, "id", "code", distance, bits))
    left, right = actors.select(F.col("class").alias("ka"), F.col("id").alias("x")), actors.select(F.col("class").alias("kb"), F.col("id").alias("y"))
    edges = pairs.join(left, F.col("a") == F.col("ka")).join(right, F.col("b") == F.col("kb")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    decided = greedy_near_copies(actors, edges, "id", F.col("o"), F.col("safe"), keep)
    others = F.when(F.col("safe") | F.col("code").isNull(), "kept").otherwise("dropped")
    return rows.join(decided, "id", "left").select("id", F.coalesce("state", others).alias("state"))


def greedy_near_copies(df: DataFrame, edges: DataFrame, record: str, order: Column, protected: Column, keep) -> DataFrame:
    """What a sequential pass in ``order`` would keep, when a record is dropped if it is near a
    record kept before (protected ones are always kept): a fixpoint over the edge table.

    ``keep`` stores a table between rounds (for instance in a checkpoint folder)."""
    ranked = df.select(F.col(record).alias("id"), order.alias("o"), F.coalesce(protected, F.lit(False)).alias("safe"))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left, right = ranked.select(F.col("id").alias("a"), F.col("o").alias("oa")), ranked.select(F.col("id").alias("b"), F.col("o").alias("ob"))
    earlier = keep(both.join(left, "a").join(right, "b").where(F.struct("oa", "a") < F.struct("ob", "b")).select("a", "b"))
    state = keep(ranked.join(earlier.select(F.col("b").alias("id")).distinct().withColumn("near", F.lit(True)), "id", "left").select("id", F.when(F.col("safe") | F.col("near").isNull(), "kept").alias("state")))
    while not state.where("state is null").isEmpty():
        seen = earlier.join(state.select(F.col("id").alias("a"), "state"), "a").groupBy(F.col("b").alias("id")).agg(F.max((F.col("state") == "kept").cast("int")).alias("hit"), F.min(F.coalesce((F.col("state") == "dropped").cast("int"), F.lit(0))).alias("clear"))
        state = keep(state.join(seen, "id", "left").select("id", F.coalesce("state", F.when(F.col("hit") == 1, "dropped").when(F.col("clear") == 1, "kept")).alias("state")))
    return state
