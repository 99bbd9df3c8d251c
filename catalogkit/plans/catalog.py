"""Queries of the record catalog: rules, matches, precedence, duplicates.

The driver's ``part`` table stands for the catalog: parts are records with a source, a
path in that source's folder layout, a title, an asset for some, and a wordmark flag;
entities are the distinct part names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogkit.functions import fixed, keys
from catalogkit.operators import curate, resolve, rules
from catalogkit.plans.registry import query, table
from catalogkit.sources import files, shared
from catalogkit.plans.scalar import NORM

SOURCES = ("svglogo", "thesvg", "vectorlogozone", "wikimedia", "gilbarbara", "car-logos", "website-icons")
PATHS = (
    "vendor/svglogo/%s.svg", "vendor/thesvg/public/icons/%s/default.svg", "vendor/vectorlogozone/www/logos/%s/%s-icon.svg", "assets/_raw/wikimedia/%s/x.svg",
    "vendor/gilbarbara-logos/logos/%s-icon.svg", "vendor/car-logos-dataset/logos/optimized/%s.png", "site/%s/public/favicon.ico",
)

RECORDS = f"""
b AS (SELECT *, replace(p_name, ' ', '-') dash, CAST(p_partkey % 7 AS INT) + 1 sno FROM part),
r AS (SELECT p_partkey record_id, p_name title, {list(SOURCES)!r}[sno] source, replace({list(PATHS)!r}[sno], '%s', dash) path, p_size % 7 = 0 wordmark, CASE WHEN p_size % 3 = 0 THEN concat(dash, '.webp') END asset,
      CASE WHEN sno = 1 THEN concat(lower(p_type), '_', dash) END legacy, concat(lower(p_type), '; ', p_brand) notes, p_size size, p_retailprice price, p_type kind FROM b)"""


def records(spark: SparkSession, d: str) -> DataFrame:
    dash = F.replace("p_name", F.lit(" "), F.lit("-"))
    no = (F.col("p_partkey") % 7).cast("int")
    part = table(spark, d, "part").withColumn("dash", dash)
    path = F.replace(F.get(F.array(*map(F.lit, PATHS)), no), F.lit("%s"), F.col("dash"))
    return part.select(
        F.col("p_partkey").alias("record_id"), F.col("p_name").alias("title"), F.get(F.array(*map(F.lit, SOURCES)), no).alias("source"), path.alias("path"),
        (F.col("p_size") % 7 == 0).alias("wordmark"), F.when(F.col("p_size") % 3 == 0, F.concat("dash", F.lit(".webp"))).alias("asset"),
        F.when(no == 0, F.concat_ws("_", F.lower("p_type"), "dash")).alias("legacy"), F.concat_ws("; ", F.lower("p_type"), "p_brand").alias("notes"),
        F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.col("p_type").alias("kind"),
    )


ALIASES = ("small ring", "blue bolt", "hot gear", "red widget", "gizmo", "ring")
ENTITY = "replace(title, ' ', '_')"


def aliases(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, ALIASES))).alias("a")).select(keys.norm_key(F.col("a"), False).alias("alias"))


@query(f"WITH {RECORDS} SELECT record_id, regexp_replace(regexp_replace(list_extract(string_split(path, '/'), CASE source WHEN 'thesvg' THEN -2 WHEN 'vectorlogozone' THEN -2 WHEN 'wikimedia' THEN -2 ELSE -1 END), '(?i)([-_ ]?(icon|default|color))?\\.(svg|png|ico)$', ''), '[^a-z0-9]+', '', 'g') canonical FROM r")
def q_canonical_key(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("record_id", keys.canonical_key(F.col("source"), F.col("path"), F.lit(None).cast("string")).alias("canonical"))


@query(f"WITH {RECORDS} SELECT record_id, CASE WHEN source = 'svglogo' THEN replace(dash2, '-', '_') WHEN source = 'website-icons' THEN lower(kind) ELSE replace(dash2, '-', '_') END entity_id FROM (SELECT *, replace(title, ' ', '-') dash2 FROM r)")
def q_entity_id(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("record_id", keys.entity_id(F.lit(None).cast("string"), F.col("source"), F.col("legacy"), F.col("path"), F.col("notes")).alias("entity_id"))


@query(f"WITH {RECORDS} SELECT record_id, NOT kind IN ('PROMO', 'SMALL') AS processable, lower(CAST(size % 2 = 0 AS VARCHAR)) = 'true' AS active FROM r WHERE size % 2 = 0")
def q_active_rows(spark: SparkSession, d: str) -> DataFrame:
    active = F.lower((F.col("size") % 2 == 0).cast("string")) == "true"
    return records(spark, d).where(active).select("record_id", (~F.col("kind").isin("PROMO", "SMALL")).alias("processable"), active.alias("active"))


@query(f"WITH {RECORDS} SELECT record_id, size / 10.0 >= 2.2 OR regexp_matches(lower(list_extract(string_split(CASE WHEN size % 5 = 0 THEN replace(path, '.svg', '-wordmark.svg') ELSE path END, '/'), -1)), '(?:wordmark|wordmard)(?:\\.(svg|png|jpe?g|webp))?$') wordmark FROM r")
def q_flag_rules(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("size") % 5 == 0, F.replace("path", F.lit(".svg"), F.lit("-wordmark.svg"))).otherwise(F.col("path"))
    return records(spark, d).select("record_id", rules.is_wordmark(path, F.col("size") / 10.0).alias("wordmark"))


ALLOWED = f"""
a AS (SELECT unnest({[x.replace(' ', '') for x in ALIASES]!r}) alias),
pp AS (SELECT record_id, title, regexp_replace(regexp_replace(unnest(string_split(lower(path), '/')), '(?i)\\.(svg|png|jpe?g|webp)$', ''), '[^a-z0-9]+', '', 'g') part FROM r),
ok AS (SELECT DISTINCT record_id FROM pp, a WHERE part IN (alias, alias || 'icon', alias || 'default', alias || 'color') OR regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') = alias
       UNION SELECT record_id FROM r WHERE legacy IN (SELECT concat(lower(p_type), '_', replace(p_name, ' ', '-')) FROM part WHERE p_partkey % 5 = 0)
       UNION SELECT record_id FROM r, a WHERE length(alias) >= 4 AND contains(regexp_replace(lower(concat(source, title)), '[^a-z0-9]+', '', 'g'), alias))"""


def allowed(spark: SparkSession, d: str) -> DataFrame:
    recommended = table(spark, d, "nation").select(F.concat(F.lit("brass_"), F.replace(F.lower("n_name"), F.lit(" "), F.lit("-"))).alias("id")).unionByName(table(spark, d, "part").where("p_partkey % 5 = 0").select(F.concat_ws("_", F.lower("p_type"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("id")))
    return rules.allowed_ids(records(spark, d), aliases(spark), ident=F.concat("source", "title"), legacy="legacy", recommended=recommended)


@query(f"WITH {RECORDS}, {ALLOWED} SELECT record_id FROM ok")
def q_allow_list(spark: SparkSession, d: str) -> DataFrame:
    return allowed(spark, d)


@query(rf"""WITH {RECORDS}, {ALLOWED} SELECT r.record_id, CASE WHEN wordmark THEN 'wordmark_or_visible_answer' WHEN source = 'svglogo' THEN NULL WHEN ok.record_id IS NULL THEN 'not_popular_quiz_brand' WHEN source = 'website-icons' THEN 'website_declared_icon_source' END reason
FROM r LEFT JOIN ok ON r.record_id = ok.record_id""")
def q_exclusion_rules(spark: SparkSession, d: str) -> DataFrame:
    marked = records(spark, d).join(allowed(spark, d).withColumn("allowed", F.lit(True)), "record_id", "left")
    chain = rules.exclusion_rules(F.col("source"), F.col("path"), F.col("title"), F.col("wordmark"), F.col("allowed"))
    return marked.select("record_id", rules.first_rule(chain).alias("reason"))


@query("SELECT vec_id, CASE WHEN n = 0 THEN 0.0 ELSE (x1 - x0 + 1) / (y1 - y0 + 1) END ratio, CASE WHEN n = 0 THEN 0.0 ELSE (x1 - x0 + 1) / (y1 - y0 + 1) END >= 2.15 excluded FROM (SELECT vec_id, count(i) FILTER (v > 0.18) n, max((i - 1) % 8) FILTER (v > 0.18) x1, min((i - 1) % 8) FILTER (v > 0.18) x0, max((i - 1) // 8) FILTER (v > 0.18) y1, min((i - 1) // 8) FILTER (v > 0.18) y0 FROM (SELECT vec_id, unnest(embedding) v, generate_subscripts(embedding, 1) i FROM embeddings) GROUP BY vec_id)")
def q_grid_bounds(spark: SparkSession, d: str) -> DataFrame:
    ratio = curate.bounds_ratio(F.col("embedding"), 8, 0.18)
    return table(spark, d, "embeddings").select("vec_id", ratio.cast("double").alias("ratio"), (ratio >= fixed.BOUNDS_RATIO).alias("excluded"))


@query(f"WITH {RECORDS} SELECT record_id FROM r WHERE asset IS NOT NULL AND NOT wordmark AND record_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def q_review_usable(spark: SparkSession, d: str) -> DataFrame:
    marked = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("record_id"))
    return records(spark, d).where("asset is not null and not wordmark").join(marked, "record_id", "left_anti").select("record_id")


@query(f"WITH {RECORDS} SELECT record_id, source <> 'website-icons' OR kind = 'PROMO' reliable FROM r")
def q_reliable_meta(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("record_id")).distinct().withColumn("known", F.lit(True))
    return records(spark, d).join(known, "record_id", "left").select("record_id", (F.col("source").isin(*fixed.RELIABLE_SOURCES) | F.coalesce("known", F.lit(False))).alias("reliable"))


FACETS = f"WITH {RECORDS} SELECT record_id, title, source FROM r WHERE source = 'thesvg' AND contains(lower(concat_ws(' ', title, source, notes)), 'ring') ORDER BY title, record_id"


@query(FACETS + " LIMIT 120 OFFSET 0")
def q_facet_search(spark: SparkSession, d: str) -> DataFrame:
    return rules.faceted(records(spark, d), {"source": "thesvg"}, "ring", ("title", "source", "notes"), ("title", "record_id")).select("record_id", "title", "source")


# entity resolution: suppliers (seed) against customers' names and parts

MATCH = rf"""
WITH {RECORDS}, e AS (SELECT DISTINCT p_name entity_id, lower(replace(p_name, ' ', '')) key, replace(p_name, ' ', '-') || '-icon' file FROM part WHERE p_size <= 25),
m AS (SELECT entity_id, record_id, min(rule) rule FROM (
  SELECT entity_id, record_id, 0 rule FROM e JOIN r ON e.entity_id || '.webp' = replace(r.asset, '-', ' ') UNION ALL
  SELECT entity_id, record_id, 1 FROM e JOIN r ON e.entity_id = r.title AND r.source <> 'thesvg' UNION ALL
  SELECT entity_id, record_id, 2 FROM e JOIN r ON e.key = regexp_replace(lower(title), '[^a-z0-9]+', '', 'g')) GROUP BY entity_id, record_id),
x AS (SELECT m.*, ['asset', 'title', 'normalised'][rule + 1] "method", ['high', 'high', 'medium'][rule + 1] confidence, CASE size % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'light' WHEN 2 THEN 'dark' ELSE 'alt' END variant, wordmark FROM m JOIN r USING (record_id)),
k AS (SELECT *, CASE confidence WHEN 'high' THEN 0 ELSE 1 END c, CASE variant WHEN 'default' THEN 0 WHEN 'light' THEN 1 WHEN 'dark' THEN 2 ELSE 10 END + CASE WHEN wordmark THEN 100 ELSE 0 END v FROM x)
SELECT entity_id, record_id, "method", confidence, row_number() OVER (PARTITION BY entity_id ORDER BY c, v, record_id) AS "rank",
  NOT wordmark AND row_number() OVER (PARTITION BY entity_id, wordmark ORDER BY c, v, record_id) = 1 recommended,
  CASE WHEN bool_and(wordmark) OVER (PARTITION BY entity_id) THEN 'only_wordmark_candidate' ELSE '' END note FROM k"""


def entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_size <= 25").select(F.col("p_name").alias("entity_id")).distinct()


@query(MATCH)
def q_rule_match(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    found = resolve.rule_match(entities(spark, d), r, [
        ("asset", "high", F.concat("entity_id", F.lit(".webp")), F.replace("asset", F.lit("-"), F.lit(" "))),
        ("title", "high", F.col("entity_id"), F.when(F.col("source") != "thesvg", F.col("title"))),
        ("normalised", "medium", keys.norm_key(F.col("entity_id")), keys.norm_key(F.col("title"))),
    ])
    variant = F.get(F.array(*map(F.lit, ("default", "light", "dark", "alt"))), (F.col("size") % 4).cast("int"))
    ranked = resolve.rank_matches(found.join(r.select("record_id", variant.alias("variant"), "wordmark").hint("merge"), "record_id"), shared.kept)
    return ranked.select("entity_id", "record_id", "method", "confidence", F.col("rank").cast("long").alias("rank"), "recommended", "note")


SHARED = rf"""
WITH {RECORDS}, e AS (SELECT DISTINCT p_name entity_id FROM part WHERE p_size <= 25), ek AS (SELECT DISTINCT entity_id, unnest([{NORM.format('entity_id')}, {NORM.format("split_part(entity_id, ' ', 2)")}]) k FROM e),
p AS (SELECT record_id, unnest(string_split(lower(path), '/')) part, title FROM r),
rk AS (SELECT DISTINCT record_id, unnest([{NORM.format('title')}, {NORM.format("regexp_replace(part, '(?i)\\.(svg|png|jpe?g|webp)$', '')")}, {NORM.format("regexp_replace(regexp_replace(part, '(?i)\\.(svg|png|jpe?g|webp)$', ''), '(?i)[-_ ]?(icon|default|color|logo)$', '')")}]) k FROM p),
hit AS (SELECT DISTINCT entity_id, record_id FROM ek JOIN rk USING (k) WHERE length(k) > 1)"""


def both_keyed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entities and records with their keys."""
    e = entities(spark, d).select("entity_id", keys.entity_keys(F.col("entity_id"), domain=F.concat(F.split_part("entity_id", F.lit(" "), F.lit(2)), F.lit(""))).alias("keys"))
    none = F.lit(None).cast("string")
    return e, records(spark, d).select("record_id", keys.record_keys(none, F.col("title"), F.col("path"), none).alias("keys"))


def sharing(spark: SparkSession, d: str) -> DataFrame:
    return resolve.key_pairs(*both_keyed(spark, d))


@query(SHARED + " SELECT entity_id, count(*) n, string_agg(DISTINCT source, ',' ORDER BY source) sources FROM hit JOIN r USING (record_id) GROUP BY entity_id")
def q_key_match(spark: SparkSession, d: str) -> DataFrame:
    hits = sharing(spark, d).join(records(spark, d).select("record_id", "source"), "record_id")
    return hits.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query(SHARED + " SELECT record_id FROM r WHERE record_id IN (SELECT record_id FROM hit)")
def q_key_match_semi(spark: SparkSession, d: str) -> DataFrame:
    e, r = both_keyed(spark, d)
    return resolve.with_a_key(r, e)


@query(SHARED + ", c AS (SELECT DISTINCT p_name entity_id, max(p_size) OVER (PARTITION BY p_name) top FROM part) SELECT c.entity_id, CASE WHEN h.entity_id IS NOT NULL THEN 'present' WHEN top >= 50 THEN 'collected' WHEN top >= 48 THEN 'error' ELSE 'missing' END status FROM c LEFT JOIN (SELECT DISTINCT entity_id FROM hit) h ON c.entity_id = h.entity_id")
def q_match_status(spark: SparkSession, d: str) -> DataFrame:
    collected = table(spark, d, "part").groupBy(F.col("p_name").alias("entity_id")).agg(F.max("p_size").alias("top"))
    present = sharing(spark, d).select("entity_id").distinct().withColumn("present", F.lit(True))
    status = rules.first_rule([("present", F.col("present")), ("collected", F.col("top") >= 50), ("error", F.col("top") >= 48), ("missing", F.lit(True))])
    return collected.join(present, "entity_id", "left").select("entity_id", status.alias("status"))


@query(f"""WITH e AS (SELECT DISTINCT p_name entity_id, regexp_replace(p_name, '[^a-z]', '', 'g') k FROM part), x AS (SELECT DISTINCT p_type || ' ' || p_name t FROM part), f AS (SELECT t record_id, regexp_replace(lower(t), '[^a-z]', '', 'g') k FROM x UNION ALL SELECT DISTINCT split_part(p_name, ' ', 2), split_part(p_name, ' ', 2) FROM part)
SELECT entity_id, record_id FROM e, f WHERE e.k = f.k OR (length(e.k) >= 4 AND contains(f.k, e.k)) OR (length(f.k) >= 4 AND contains(e.k, f.k))""")
def q_containment_match(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    e = part.select(F.col("p_name").alias("entity_id")).distinct()
    f = part.select(F.concat_ws(" ", "p_type", "p_name").alias("record_id")).unionByName(part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("record_id"))).distinct()
    return resolve.containment_pairs(e.withColumn("key", keys.norm_key(F.col("entity_id"))), f.withColumn("key", keys.norm_key(F.col("record_id"))), "entity_id", "record_id")


@query("""
WITH q AS (SELECT c_custkey entity_no, ['auto', 'house', 'build', 'machine'][c_custkey % 4 + 1] entity_id, c_mktsegment query, o_orderkey result_no, ['Automobile', 'household goods', 'Building', 'FURNITURE', 'x'][o_orderkey % 5 + 1] label, ['a car company', 'a film', 'software', 'plant'][o_orderkey % 4 + 1] descr, CASE WHEN o_orderkey % 3 = 0 THEN 'Q1' ELSE 'P1' END rid FROM customer JOIN orders ON o_custkey = c_custkey),
n AS (SELECT *, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') l, regexp_replace(lower(query), '[^a-z0-9]+', '', 'g') qn, descr IN ('a car company', 'software') biz FROM q),
c AS (SELECT *, CASE WHEN l = qn OR l = entity_id THEN 90 WHEN contains(l, qn) OR contains(qn, l) THEN 72 WHEN length(entity_id) >= 5 AND (contains(l, entity_id) OR contains(entity_id, l)) THEN 64 ELSE 0 END + CASE WHEN biz THEN 12 ELSE 0 END - CASE WHEN descr IN ('a film', 'plant') THEN 35 ELSE 0 END s0 FROM n),
s AS (SELECT *, s0 - CASE WHEN NOT biz AND s0 < 95 THEN 18 ELSE 0 END + CASE WHEN rid LIKE 'Q%' THEN 3 ELSE 0 END score FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY entity_no ORDER BY score DESC, result_no) rn FROM s)
SELECT entity_no, result_no, least(100, score) confidence FROM b WHERE rn = 1 AND score >= 80""")
def q_search_score(spark: SparkSession, d: str) -> DataFrame:
    def pick(values: tuple[str, ...], of: str):
        return F.get(F.array(*map(F.lit, values)), (F.col(of) % len(values)).cast("int"))

    found = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    score = resolve.search_score(pick(("auto", "house", "build", "machine"), "c_custkey"), F.col("c_mktsegment"), pick(("Automobile", "household goods", "Building", "FURNITURE", "x"), "o_orderkey"), pick(("a car company", "a film", "software", "plant"), "o_orderkey"), F.when(F.col("o_orderkey") % 3 == 0, "Q1").otherwise("P1"))
    scored = found.select(F.col("c_custkey").alias("entity_no"), F.lit(0).alias("query_no"), F.col("o_orderkey").alias("result_no"), score.alias("score"))
    return resolve.best_search_result(scored, "entity_no", "query_no", "result_no").select("entity_no", "result_no", "confidence")


@query("""WITH u AS (SELECT p_name k, p_brand b, 0 t FROM part WHERE p_type = 'PROMO' UNION ALL SELECT p_name, p_brand, 1 FROM part WHERE p_type = 'SMALL'),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, b) rn FROM u) SELECT k AS p_name, b AS p_brand FROM f WHERE rn = 1""")
def q_dim_first_wins(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return resolve.first_wins([part.where(F.col("p_type") == kind).select("p_name", "p_brand") for kind in ("PROMO", "SMALL")], "p_name")


@query(f"""WITH {RECORDS}, o AS (SELECT record_id, 'fixed name' nm FROM r WHERE record_id % 10 = 0), s AS (SELECT record_id, title || ' inc' nm, CASE WHEN size > 25 THEN kind END grp FROM r WHERE record_id % 3 = 0)
SELECT r.record_id, coalesce(o.nm, s.nm, r.title) name, coalesce(s.grp, {fixed.DEFAULT_GROUP!r}) AS grp FROM r LEFT JOIN o ON r.record_id = o.record_id LEFT JOIN s ON r.record_id = s.record_id""")
def q_precedence_fill(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    override = r.where("record_id % 10 = 0").select("record_id", F.lit("fixed name").alias("name"))
    seed = r.where("record_id % 3 = 0").select("record_id", F.concat("title", F.lit(" inc")).alias("name"), F.when(F.col("size") > 25, F.col("kind")).alias("grp"))
    raw = r.select("record_id", F.col("title").alias("name"), F.lit(None).cast("string").alias("grp"))
    return resolve.precedence_fill(raw, [override, seed], "record_id", ("name", "grp"), {"grp": fixed.DEFAULT_GROUP})


@query("SELECT l_orderkey, l_linenumber, p_name, coalesce(s_name, 'none') supplier, CASE WHEN l_returnflag = 'R' THEN 90 ELSE 60 END score FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey")
def q_index_join(spark: SparkSession, d: str) -> DataFrame:
    matches, part, supplier = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "supplier").where("s_acctbal > 0")
    joined = matches.join(part, F.col("p_partkey") == F.col("l_partkey"), "left").join(supplier, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return joined.select("l_orderkey", "l_linenumber", "p_name", F.coalesce("s_name", F.lit("none")).alias("supplier"), F.when(F.col("l_returnflag") == "R", 90).otherwise(60).alias("score"))


@query("""WITH d AS (SELECT c_custkey, CASE WHEN c_acctbal > 4000 THEN concat('www.', lower(c_mktsegment), '.com') END own, list(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE concat(lower(o_orderstatus), '.com') END ORDER BY o_orderkey) found FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
f AS (SELECT *, list_extract(list_filter(found, lambda x: x IS NOT NULL AND x <> '.com'), 1) top FROM d)
SELECT c_custkey, coalesce(own, top) resolved_domain, CASE WHEN own IS NOT NULL THEN 'seed' WHEN top IS NOT NULL THEN 'search' ELSE 'missing' END domain_source, top search_top_domain, CASE WHEN own IS NOT NULL AND top IS NOT NULL THEN replace(own, 'www.', '') = top END domain_matches_existing FROM f""")
def q_resolve_domain(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "F", F.concat(F.lower("o_orderstatus"), F.lit(".com"))).alias("domain"))
    results = found.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "domain"))).alias("results"))
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 4000, F.concat(F.lit("www."), F.lower("c_mktsegment"), F.lit(".com"))).alias("own"))
    joined = c.join(results, F.col("c_custkey") == F.col("o_custkey"), "left")
    return resolve.resolve_domain(joined, F.col("own"), F.col("results")).select("c_custkey", "resolved_domain", "domain_source", "search_top_domain", "domain_matches_existing")


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'covered' WHEN c_acctbal <= 0 THEN 'no_domain' END skip_reason FROM customer")
def q_work_list(spark: SparkSession, d: str) -> DataFrame:
    covered = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.concat(F.lit("c"), "c_custkey")).alias("domain"))
    return resolve.work_list(c, covered, "c_custkey", "domain").select("c_custkey", "skip_reason")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'N')")
def q_incremental(spark: SparkSession, d: str) -> DataFrame:
    state = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return resolve.still_to_do(table(spark, d, "orders").select("o_orderkey"), state, "o_orderkey", "l_returnflag", retry=("N",))


@query("WITH u AS (SELECT user_id, event_id, ts, event_type FROM events) SELECT user_id, max_by(event_type, (ts, event_id)) event_type, max(ts) ts FROM u GROUP BY user_id")
def q_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    half = F.col("event_id") % 2 == 0
    return resolve.upsert_latest(e.where(half), e.where(~half), "user_id", "ts").select("user_id", "event_type", "ts")


# picks and duplicates

PRIORITY = f"CASE source {' '.join(f'WHEN {k!r} THEN {v}' for k, v in fixed.SOURCE_PRIORITY.items())} ELSE 100 END + CASE WHEN asset IS NOT NULL THEN 20 ELSE 0 END"
DEDUPE = f"CASE source {' '.join(f'WHEN {k!r} THEN {v}' for k, v in fixed.DEDUPE_PRIORITY.items())} ELSE 100 END + 20 + CASE WHEN asset IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN size = 1 THEN 1000 ELSE 0 END"


@query(f"WITH {RECORDS}, k AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY {PRIORITY} DESC, record_id) rn FROM r) SELECT title, record_id, source FROM k WHERE rn = 1")
def q_best_record(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return curate.best_per(r, "title", curate.source_priority(F.col("source"), F.col("asset")), ("record_id",)).select("title", "record_id", "source")


@query(f"WITH {RECORDS}, k AS (SELECT *, first_value(record_id) OVER (PARTITION BY title ORDER BY {DEDUPE} DESC, record_id) keeper FROM r) SELECT record_id, CASE WHEN keeper <> record_id AND NOT (source = 'svglogo' AND NOT wordmark) THEN keeper END duplicate_of FROM k")
def q_canonical_dedupe(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    priority = curate.dedupe_priority(F.col("source"), F.col("title"), F.col("asset"), F.col("size") == 1)
    return curate.mark_copies(r, "title", "record_id", priority, ("record_id",), rules.is_protected(F.col("source"), F.col("wordmark"))).select("record_id", "duplicate_of")


# titles repeat; some bases are other titles with a number, which clash, and some rows have no title
BASES = f"""{RECORDS}, named AS (SELECT record_id, CASE WHEN size % 23 = 0 THEN NULL WHEN record_id % 5 = 0 THEN concat({ENTITY}, '_', size % 6) WHEN record_id % 17 = 0 THEN concat({ENTITY}, '_2_', size % 4) ELSE {ENTITY} END base FROM r)"""


@query(f"""WITH RECURSIVE {BASES}, o AS MATERIALIZED (SELECT *, regexp_replace(base, '(_[0-9]+)+$', '') stem FROM named), q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY record_id) no FROM o WHERE base IS NOT NULL),
s(stem, no, record_id, given, used) AS (SELECT stem, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[]) FROM q GROUP BY stem UNION ALL
SELECT stem, no, record_id, given, list_append(used, given) FROM (SELECT q.stem, q.no, q.record_id, s.used, list_filter(list_prepend(q.base, list_transform(range(2, len(s.used) + 3), lambda k: concat(q.base, '_', k))), lambda x: NOT list_contains(s.used, x))[1] given FROM s JOIN q ON q.stem = s.stem AND q.no = s.no + 1))
SELECT record_id, given unique_id FROM s WHERE no > 0 UNION ALL SELECT record_id, NULL FROM named WHERE base IS NULL""")
def q_unique_id(spark: SparkSession, d: str) -> DataFrame:
    title, size, k = F.replace("title", F.lit(" "), F.lit("_")), F.col("size"), F.col("record_id")
    base = F.when(size % 23 == 0, F.lit(None)).when(k % 5 == 0, F.concat_ws("_", title, size % 6)).when(k % 17 == 0, F.concat(title, F.lit("_2_"), size % 4)).otherwise(title)
    return curate.unique_ids(records(spark, d).select("record_id", base.alias("base")), "base", ("record_id",), shared.kept).select("record_id", "unique_id")


@query("""WITH a AS (SELECT l_orderkey, list(DISTINCT ['logo_dark', 'icon_light', 'symbol_dark', 'other'][l_linenumber % 4 + 1]) vs FROM lineitem GROUP BY l_orderkey),
p AS (SELECT l_orderkey, list_extract(list_filter(['symbol_light', 'symbol_dark', 'icon_light', 'icon_dark', 'logo_light', 'logo_dark'], lambda x: list_contains(vs, x)), 1) picked FROM a)
SELECT l_orderkey, picked, CASE WHEN picked LIKE 'logo_%' THEN 'needs_manual_review' WHEN picked IS NULL THEN 'missing' ELSE 'approved' END review FROM p""")
def q_preference_pick(spark: SparkSession, d: str) -> DataFrame:
    variant = F.get(F.array(*map(F.lit, ("logo_dark", "icon_light", "symbol_dark", "other"))), (F.col("l_linenumber") % 4).cast("int"))
    held = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(variant).alias("vs"))
    review = F.when(F.col("picked").startswith("logo_"), "needs_manual_review").when(F.col("picked").isNull(), "missing").otherwise("approved")
    return held.select("l_orderkey", curate.preferred(F.col("vs")).alias("picked")).withColumn("review", review)


@query("SELECT l_orderkey, min_by(l_partkey, (l_linenumber, l_partkey)) FILTER (l_returnflag = 'N') l_partkey FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_returnflag = 'N') > 0")
def q_first_success(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_returnflag = 'N'").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("l_partkey"))


@query("WITH u AS (SELECT p_name k, 0 t, p_partkey v FROM part UNION ALL SELECT lower(p_name), 1, p_partkey FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, v) rn FROM u WHERE k <> '') SELECT k AS candidate_id, v AS record_id FROM n WHERE rn = 1")
def q_union_dedupe(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return resolve.first_wins([part.select(F.col("p_name").alias("candidate_id"), F.col("p_partkey").alias("record_id")), part.select(F.lower("p_name").alias("candidate_id"), F.col("p_partkey").alias("record_id"))], "candidate_id")


# 256 cells: a vector and its reverse, twice, where every odd vector is the one before it with its first value negated
GRIDS = """e AS (SELECT vec_id, embedding x FROM embeddings), g0 AS (SELECT a.vec_id, CASE WHEN a.vec_id % 2 = 1 THEN list_prepend(-b.x[1], b.x[2:]) ELSE b.x END x FROM e a JOIN e b ON b.vec_id = a.vec_id - a.vec_id % 2),
g AS (SELECT vec_id, list_transform(list_concat(list_concat(x, list_reverse(x)), list_concat(x, list_reverse(x))), lambda v: CAST(v AS DOUBLE)) x FROM g0),
h AS (SELECT vec_id, list_transform(x, lambda v: v >= m) bits FROM (SELECT vec_id, x, list_sum(x) / len(x) m FROM g))"""


def grids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    base = e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    changed = F.transform("y", lambda v, i: F.when((i == 0) & (F.col("vec_id") % 2 == 1), -v).otherwise(v))
    of = e.join(base, F.col("b") == F.col("vec_id") - F.col("vec_id") % 2).select("vec_id", changed.alias("x"))
    return of.select("vec_id", F.concat("x", F.reverse("x"), "x", F.reverse("x")).alias("grid"))


def hashes(spark: SparkSession, d: str) -> DataFrame:
    return grids(spark, d).select("vec_id", curate.average_hash(F.col("grid")).alias("code"))


@query(f"WITH {GRIDS}, w AS (SELECT vec_id, unnest(range(0, 4)) k, bits FROM h), c AS (SELECT vec_id, k, list_sum(list_transform(bits[k * 64 + 1:k * 64 + 64], lambda b, i: CASE WHEN b THEN CAST(1 AS HUGEINT) << CAST(i - 1 AS INT) ELSE 0 END)) c FROM w) SELECT vec_id, string_agg(CASE WHEN c >= 9223372036854775808 THEN c - 18446744073709551616 ELSE c END, ',' ORDER BY k) code FROM c GROUP BY vec_id")
def q_average_hash(spark: SparkSession, d: str) -> DataFrame:
    return hashes(spark, d).select("vec_id", F.array_join(F.transform("code", lambda w: w.cast("string")), ",").alias("code"))


NEAR = f"{GRIDS}, hb AS MATERIALIZED (SELECT vec_id, CAST(array_to_string(list_transform(bits, lambda b: CASE WHEN b THEN '1' ELSE '0' END), '') AS BIT) code FROM h), n4 AS MATERIALIZED (SELECT a.vec_id a, b.vec_id b, CAST(bit_count(xor(a.code, b.code)) AS INT) distance FROM hb a JOIN hb b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.code, b.code)) <= 4)"


@query(f"WITH {NEAR}, k AS (SELECT vec_id, min(vec_id) OVER (PARTITION BY code) class FROM hb) SELECT a, b, distance FROM n4 WHERE a IN (SELECT class FROM k) AND b IN (SELECT class FROM k) UNION ALL SELECT class, vec_id, 0 FROM k WHERE class <> vec_id")
def q_hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of close hashes, each by its smallest record, and the other records of each hash with that one."""
    h = shared.kept(hashes(spark, d))
    copies = curate.hash_classes(h, "vec_id", "code").where("class <> vec_id").select(F.col("class").alias("a"), F.col("vec_id").alias("b"), F.lit(0).alias("distance"))
    return curate.banded_pairs(h, "vec_id", "code").unionByName(copies)


@query(f"WITH {RECORDS} SELECT record_id, CASE WHEN source = 'thesvg' THEN CASE WHEN contains(lower(f), 'wordmark') THEN 45 ELSE 72 END WHEN source = 'vectorlogozone' THEN CASE WHEN contains(lower(f), 'icon') THEN 76 ELSE 60 END WHEN source = 'gilbarbara' THEN 70 WHEN source = 'car-logos' THEN 75 ELSE 60 END score FROM (SELECT record_id, source, CASE WHEN size % 5 = 0 THEN replace(path, '.svg', '-wordmark.svg') ELSE path END f FROM r)")
def q_file_score(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("size") % 5 == 0, F.replace("path", F.lit(".svg"), F.lit("-wordmark.svg"))).otherwise(F.col("path"))
    return records(spark, d).select("record_id", keys.file_score(F.col("source"), path).alias("score"))


@query("WITH s AS (SELECT p_name k, p_partkey v FROM part WHERE p_size <= 25), n AS (SELECT p_name k, p_partkey v FROM part WHERE p_size > 20) SELECT k AS name, v AS record_id FROM s UNION ALL SELECT k, v FROM n WHERE k NOT IN (SELECT k FROM s)")
def q_append_new(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("record_id"), "p_size")
    return resolve.append_new(part.where("p_size <= 25"), part.where("p_size > 20"), "name").select("name", "record_id")


@query("SELECT DISTINCT id FROM (SELECT doc_id id FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id + 1 FROM labels WHERE toxic = 1 AND doc_id % 2 = 0)")
def q_remapped_marks(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    moved = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("old"), (F.col("doc_id") + 1).alias("new"))
    return files.remapped_ids(marks, moved, "old", "new")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) / (p_partkey % 7 + 1) WHEN p_partkey % 3 = 1 THEN CAST(p_size AS DOUBLE) / 20 ELSE 0.0 END ratio FROM part""")
def q_aspect_ratio(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    box = F.concat(F.lit('<svg viewBox="0 0 '), size, F.lit(" "), (k % 7 + 1).cast("string"), F.lit('">'))
    svg = F.when(k % 3 == 0, box).when(k % 3 == 1, F.concat(F.lit('<svg width="'), size, F.lit('" height="20">'))).otherwise(F.lit("<svg>"))
    return table(spark, d, "part").select("p_partkey", keys.aspect_ratio(svg).alias("ratio"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand WHEN p_size % 3 = 0 THEN p_type ELSE p_name END label, CASE WHEN p_size % 5 = 0 THEN p_type ELSE p_brand END claim FROM part")
def q_label_fallback(spark: SparkSession, d: str) -> DataFrame:
    labels = F.create_map(F.lit("zh-hans"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.lit("zh-cn"), F.lit(""), F.lit("zh"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")))
    claims = F.create_map(F.lit("P154"), F.when(F.col("p_size") % 5 == 0, F.array("p_type")).otherwise(F.array(F.lit(""))), F.lit("P94"), F.array("p_brand", "p_name"))
    return table(spark, d, "part").select("p_partkey", resolve.label_in(labels, ("zh-hans", "zh-cn", "zh"), F.col("p_name")).alias("label"), resolve.first_claim(claims, ("P154", "P94")).alias("claim"))
