"""Entity resolution: ranked rule joins, key joins, containment, scoring, precedence."""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalogkit.functions import fixed, keys
from catalogkit.operators import analytics


def rule_match(entities: DataFrame, records: DataFrame, rules: list[tuple[str, str, Column, Column]], entity: str = "entity_id", record: str = "record_id") -> DataFrame:
    """Pairs that match by an equality rule; the first rule of a pair gives ``method`` and
    ``confidence``. Each rule (method, confidence, entity key, record key) is an equi join,
    so no pair is looked at that shares no key; it is hinted, as Spark would broadcast all records of a small file."""
    found = None
    for no, (_, _, left, right) in enumerate(rules):
        a = entities.select(F.col(entity), left.alias("k")).where("k is not null and k <> ''")
        b = records.select(F.col(record), right.alias("k")).where("k is not null and k <> ''")
        hit = a.join(b.hint("merge"), "k").select(entity, record, F.lit(no).alias("rule_no"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(entity, record).agg(F.min("rule_no").alias("rule_no"))
    method = F.element_at(F.array(*(F.lit(m) for m, *_ in rules)), F.col("rule_no") + 1)
    confidence = F.element_at(F.array(*(F.lit(c) for _, c, *_ in rules)), F.col("rule_no") + 1)
    return best.select(entity, record, method.alias("method"), confidence.alias("confidence"))


def variant_rank(variant: Column, wordmark: Column) -> Column:
    return F.when(F.coalesce(wordmark, F.lit(False)), fixed.WORDMARK_PENALTY).otherwise(0) + keys.mapped(variant, fixed.VARIANT_RANK, fixed.OTHER_VARIANT)


def rank_matches(matches: DataFrame, keep: Callable[[DataFrame], DataFrame], entity: str = "entity_id", record: str = "record_id") -> DataFrame:
    """``rank`` of each record of an entity, ``recommended`` (the first, if no wordmark) and a note
    for entities that have wordmarks only. Entities with many records are dealt by ranges of the order (``keep``: see
    ``running_sums``), so that none is sorted as one group."""
    plain = ~F.coalesce("wordmark", F.lit(False))
    order = F.struct(keys.mapped(F.col("confidence"), fixed.CONFIDENCE_RANK, 9).alias("c"), variant_rank(F.col("variant"), F.col("wordmark")).alias("v"), F.col(record).alias("r"))
    out = analytics.running_sums(matches.withColumn("__order", order), entity, "__order", {"plain": plain.cast("long")}, keep)
    some = out.where(plain & (F.col("plain") == 1)).select(F.col(entity).alias("__entity"), F.lit(True).alias("__some"))  # one row an entity
    out = out.withColumn("recommended", plain & (F.col("plain") == 1)).join(some, F.col(entity).eqNullSafe(F.col("__entity")), "left")
    return out.withColumn("note", F.when(F.col("__some"), "").otherwise("only_wordmark_candidate")).withColumnRenamed("n", "rank").drop("total", "plain", "__order", "__entity", "__some")


FILTER_BITS = 24  # of the filter of keys: 2 MB, in rows of 4 KB
HOT_KEYS = 1_000  # a key is hot with more than one of so many rows, so there are no more of them
SALTS = 32


def possible(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """``rows`` without most of those whose key is not in column ``k`` of ``known``: a bit map of hashed keys, of fixed size,
    goes to all tasks. Few others pass by chance."""
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    bits = known.select(cell("k").alias("c")).groupBy(F.shiftright("c", 15).alias("__at")).agg(F.bitmap_construct_agg(F.col("c") % (1 << 15)).alias("__bits"))
    asked = rows.withColumn("__c", cell(key)).withColumn("__bit", F.col("__c") % (1 << 15))
    hit = asked.join(F.broadcast(bits), F.shiftright("__c", 15) == F.col("__at"))
    octet = F.conv(F.hex(F.substring("__bits", F.shiftright("__bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return hit.where(F.call_function("shiftright", octet, (F.col("__bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1).select(*rows.columns)


def listed_keys(entities: DataFrame, records: DataFrame, entity: str, record: str, entity_keys: str, record_keys: str) -> tuple[DataFrame, DataFrame]:
    """Both key arrays as rows (``k``, and ``salt``): only keys that the other side may have, and hot keys of the records dealt
    to salts, for each of which the entity comes once."""
    a = entities.select(entity, F.explode(F.array_distinct(entity_keys)).alias("k"))
    b = possible(records.select(record, F.explode(F.array_distinct(record_keys)).alias("k")), "k", a)
    counts = b.groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    total = counts.agg(F.sum("m").alias("all"))
    hot = counts.join(F.broadcast(total)).where((F.col("m") > 1) & (F.col("m") * HOT_KEYS > F.col("all"))).select(F.col("k").alias("__hot"))  # one row of the total
    marked = lambda rows: rows.join(F.broadcast(hot), F.col("k") == F.col("__hot"), "left")
    zero = F.lit(0)
    salted = marked(b).withColumn("salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(record), F.lit(SALTS)).cast("int")).otherwise(zero)).drop("__hot")
    spread = marked(a).withColumn("salt", F.explode(F.when(F.col("__hot").isNotNull(), F.sequence(zero, F.lit(SALTS - 1))).otherwise(F.array(zero)))).drop("__hot")
    return spread, salted


def key_pairs(entities: DataFrame, records: DataFrame, entity: str = "entity_id", record: str = "record_id", entity_keys: str = "keys", record_keys: str = "keys") -> DataFrame:
    """Distinct pairs that share a key: both key arrays exploded, one equi join of keys that may be on both sides, in which a hot key
    of the records is spread over tasks."""
    a, b = listed_keys(entities, records, entity, record, entity_keys, record_keys)
    return a.join(b, ["k", "salt"]).select(entity, record).distinct()


def with_a_key(records: DataFrame, entities: DataFrame, entity: str = "entity_id", record: str = "record_id", entity_keys: str = "keys", record_keys: str = "keys") -> DataFrame:
    """The records of which some entity has a key, without the pairs."""
    a, b = listed_keys(entities, records, entity, record, entity_keys, record_keys)
    return b.join(a, ["k", "salt"], "left_semi").select(record).distinct()


def held_patterns(b: pd.DataFrame) -> pd.DataFrame:
    """Which short keys the long keys of a cell hold: one pass of an automaton of all short ones over each long one."""
    words = ahocorasick.Automaton()
    for short in b.loc[b["short"], "key"]:
        words.add_word(short, short)
    found = []
    if len(words):
        words.make_automaton()
        for long in b.loc[~b["short"], "key"]:
            found += [(short, long) for short in {w for _, w in words.iter(long)}]
    return pd.DataFrame(found, columns=["s", "l"], dtype=object)


def held_keys(shorts: DataFrame, longs: DataFrame, least: int, crowded: int, cell: int) -> DataFrame:
    """``s``, ``l``: keys (column ``key``, distinct) of ``shorts`` of ``least`` characters or more that lie within longer keys of ``longs``.

    A short key is looked for where its rarest n-gram of ``least`` characters is. Blocks of few pairs are joined; in those of more
    than ``crowded`` pairs both sides are dealt to cells of about ``cell`` keys, in which an automaton finds all short keys at once, so
    that a block costs its keys, not its pairs."""

    def grams(df: DataFrame) -> DataFrame:
        every = F.transform(F.sequence(F.lit(1), F.length("key") - (least - 1)), lambda i: F.substr(F.col("key"), i, F.lit(least)))
        return df.where(F.length("key") >= least).select("key", F.explode(F.array_distinct(every)).alias("g"))

    there = grams(longs)
    known = there.groupBy("g").agg(F.count(F.lit(1)).alias("nl"))
    picked = grams(shorts).join(known, "g").groupBy(F.col("key").alias("s")).agg(F.min(F.struct("nl", "g")).alias("x")).select("s", "x.g", "x.nl")
    blocks = picked.groupBy("g").agg(F.count(F.lit(1)).alias("ns"), F.first("nl").alias("nl"))
    blocks = blocks.withColumn("crowded", F.col("ns") * F.col("nl") > crowded)
    few, many = blocks.where(~F.col("crowded")).select("g"), blocks.where("crowded").select("g", F.ceil(F.col("ns") / cell).cast("int").alias("cs"), F.ceil(F.col("nl") / cell).cast("int").alias("cl"))
    joined = picked.join(few, "g", "left_semi").select("s", "g").join(there.withColumnRenamed("key", "l"), "g").where((F.length("l") > F.length("s")) & F.contains("l", "s")).select("s", "l")
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = picked.join(many, "g").select(F.col("s").alias("key"), "g", place("s", "cs").alias("i"), F.col("cl").alias("n")).select("key", "g", "i", every("n").alias("j"), F.lit(True).alias("short"))
    right = there.join(many, "g").select("key", "g", place("key", "cl").alias("j"), F.col("cs").alias("n")).select("key", "g", every("n").alias("i"), "j", F.lit(False).alias("short"))
    found = left.unionByName(right).groupBy("g", "i", "j").applyInPandas(held_patterns, "s string, l string").where(F.length("l") > F.length("s"))
    return joined.unionByName(found)


def containment_pairs(entities: DataFrame, records: DataFrame, entity: str, record: str, least: int = 4, crowded: int = 1_000_000, cell: int = 20_000) -> DataFrame:
    """Pairs of different tables whose keys (column ``key``) are equal or hold one another.

    Keys shorter than ``least`` match by equality only. Keys are compared once, however many rows have them (see ``held_keys``);
    rows meet by joins on keys in the end. Blank and null keys match nothing."""
    a = entities.select(F.col(entity), F.col("key").alias("ka")).where("ka <> ''")
    b = records.select(F.col(record), F.col("key").alias("kb")).where("kb <> ''")
    left, right = a.select(F.col("ka").alias("key")).distinct(), b.select(F.col("kb").alias("key")).distinct()
    inside = held_keys(left, right, least, crowded, cell).select(F.col("s").alias("ka"), F.col("l").alias("kb"))
    around = held_keys(right, left, least, crowded, cell).select(F.col("l").alias("ka"), F.col("s").alias("kb"))
    equal = left.join(right, "key").select(F.col("key").alias("ka"), F.col("key").alias("kb"))
    return equal.unionByName(inside).unionByName(around).join(a, "ka").join(b, "kb").select(entity, record).distinct()


def search_score(entity: Column, query: Column, label: Column, description: Column, result: Column) -> Column:
    """Score of a search result for a query."""
    q, i, lab = keys.norm_key(query), keys.norm_key(entity), keys.norm_key(label)
    low = F.lower(F.coalesce(description, F.lit("")))
    business = low.rlike(rf"\b({'|'.join(fixed.BUSINESS_WORDS)})\b")
    close = F.when((lab == q) | (lab == i), 90).when(F.contains(lab, q) | F.contains(q, lab), 72).when((F.length(i) >= 5) & (F.contains(lab, i) | F.contains(i, lab)), 64).otherwise(0)
    topical = close + F.when(business, 12).otherwise(0) - F.when(low.rlike(rf"\b({'|'.join(fixed.OFF_TOPIC_WORDS)})\b"), 35).otherwise(0)
    return topical - F.when(~business & (topical < 95), 18).otherwise(0) + F.when(F.coalesce(result, F.lit("")).startswith("Q"), 3).otherwise(0)


def best_search_result(scored: DataFrame, entity: str = "entity_id", query_no: str = "query_no", position: str = "position", score: str = "score", accept: int = 80, most: int = 100) -> DataFrame:
    """The best result of the first query whose best result is accepted."""
    first = W.partitionBy(entity, query_no).orderBy(F.col(score).desc(), position)
    best = scored.withColumn("__n", F.row_number().over(first)).where(F.col("__n") == 1).where(F.col(score) >= accept)
    chosen = best.withColumn("__n", F.row_number().over(W.partitionBy(entity).orderBy(query_no))).where(F.col("__n") == 1)
    return chosen.withColumn("confidence", F.least(F.lit(most), F.col(score))).drop("__n")


def first_wins(tables: list[DataFrame], key: str) -> DataFrame:
    """Union of tables of which the first that has a key gives its row; blank keys are out."""
    every = None
    for no, t in enumerate(tables):
        t = t.withColumn("__table", F.lit(no))
        every = t if every is None else every.unionByName(t, allowMissingColumns=True)
    every = every.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    rest = [c for c in every.columns if c not in (key, "__table")]
    picked = every.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("__table", *(c for c in rest))).alias("r"))
    return picked.select(key, "r.*")


def precedence_fill(df: DataFrame, layers: list[DataFrame], on: str, columns: tuple[str, ...], default: dict[str, object] | None = None) -> DataFrame:
    """Each column from the first layer that fills it, then from ``df`` itself, then the default."""
    for no, layer in enumerate(layers):
        df = df.join(layer.select(on, *(F.col(c).alias(f"__{no}_{c}") for c in columns if c in layer.columns)), on, "left")
    out = []
    for c in columns:
        filled = [F.col(f"__{no}_{c}") for no, layer in enumerate(layers) if c in layer.columns]
        out.append(keys.first_filled(*filled, F.col(c), F.lit((default or {}).get(c))).alias(c))
    others = [c for c in df.columns if c not in columns and not c.startswith("__")]
    return df.select(*others, *out)


def resolve_domain(df: DataFrame, own: Column, results: Column) -> DataFrame:
    """``resolved_domain``, its source, the first search domain, and whether they agree."""
    found = F.get(F.filter(F.transform(results, lambda r: r["domain"]), lambda d: F.trim(F.coalesce(d, F.lit(""))) != ""), F.lit(0))
    mine, top = keys.first_filled(own), keys.first_filled(found)
    return df.withColumns({
        "resolved_domain": F.coalesce(mine, top), "domain_source": F.when(mine.isNotNull(), "seed").when(top.isNotNull(), "search").otherwise("missing"),
        "search_top_domain": top, "domain_matches_existing": F.when(mine.isNotNull() & top.isNotNull(), keys.host(mine) == keys.host(top)),
    })


def work_list(entities: DataFrame, covered: DataFrame, entity: str, domain: str) -> DataFrame:
    """Every entity with ``skip_reason``; null: still to be worked on."""
    done = covered.select(F.col(entity).alias("__done")).distinct()
    out = entities.join(done, F.col(entity) == F.col("__done"), "left")
    return out.withColumn("skip_reason", F.when(F.col("__done").isNotNull(), "covered").when(keys.first_filled(F.col(domain)).isNull(), "no_domain")).drop("__done")


def still_to_do(items: DataFrame, state: DataFrame, key: str, status: str = "status", retry: tuple[str, ...] = ("error",), force: bool = False) -> DataFrame:
    """Items not processed before; those whose status calls for it come again."""
    return items if force else items.join(state.where(~F.col(status).isin(*retry)).select(key).distinct(), key, "left_anti")


def upsert_latest(state: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key; of rows of one time the one from ``new`` stays."""
    every = state.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in every.columns if c not in (key, "__new")]
    return every.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, "__new", *rest)).alias("r")).select(key, "r.*")


def append_new(state: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The state and the rows of new keys; run again with the same rows it adds nothing."""
    return state.unionByName(new.join(state.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def label_in(labels: Column, languages: tuple[str, ...], fallback: Column) -> Column:
    """A label from a map language -> label: the first language that has one, else the fallback."""
    return keys.first_filled(*(labels[x] for x in languages), fallback)


def first_claim(claims: Column, properties: tuple[str, ...]) -> Column:
    """The first value of the first property that has one, from a map property -> values."""
    return F.get(F.filter(F.flatten(F.array(*(F.coalesce(claims[p], F.array().cast("array<string>")) for p in properties))), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0))
