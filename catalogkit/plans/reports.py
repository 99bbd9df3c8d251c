"""Queries of counts, coverage, budgets, response statistics and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogkit.functions import fixed, keys
from catalogkit.operators import analytics, itembank, resolve, rules
from catalogkit.plans.catalog import RECORDS, entities, records, sharing, SHARED
from catalogkit.plans.registry import query, table
from catalogkit.sources import files
from catalogkit.sources.shared import kept

# events as answers: the user's answer of a type, in a category, right for even k, value as latency

ANSWERS = "a AS (SELECT event_id, user_id, ts, event_type, CAST(regexp_extract(props, '\"k\": ?(\\d+)', 1) AS INT) k, CAST(value * 100 AS BIGINT) latency FROM events), w AS (SELECT *, k % 2 = 0 correct, CASE WHEN k % 11 = 0 THEN NULL ELSE concat('g', k % 10) END grp FROM a)"
GROUPED = f"""
g AS (SELECT coalesce(grp, {fixed.DEFAULT_GROUP!r}) grp, count(*) total, count(*) FILTER (correct) correct, CAST(floor(count(*) FILTER (correct) / count(*) * 100 + 0.5) AS BIGINT) accuracy, CAST(floor(sum(latency) / count(*) + 0.5) AS BIGINT) mean_latency FROM w GROUP BY 1)"""


def answers(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    a = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", k.alias("k"), (F.col("value") * 100).cast("decimal(20,0)").cast("long").alias("latency"))
    return a.withColumn("correct", F.col("k") % 2 == 0).withColumn("grp", F.when(F.col("k") % 11 != 0, F.concat(F.lit("g"), F.col("k") % 10)))


@query(f"WITH {ANSWERS} SELECT event_id, grp FROM w WHERE k % 2 = 0 AND k >= 80")
def q_map_records(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d)
    one = a.select(F.create_map("event_id", F.struct(F.when(F.col("correct"), "matched").otherwise("error").alias("status"), F.col("k").alias("confidence"), "grp")).alias("records"))
    return files.map_records(one, "records").select(F.col("key").alias("event_id"), "grp")


@query("SELECT DISTINCT id FROM (SELECT doc_id id FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id + 1 FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id + 2 FROM labels WHERE quality = 0)")
def q_review_marks(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "labels").select(
        F.create_map("doc_id", F.struct((F.col("toxic") == 1).alias("wordmark"))).alias("marks"),
        F.when(F.col("doc_id") % 3 == 0, F.array(F.col("doc_id") + 1)).otherwise(F.array().cast("array<bigint>")).alias("auto"),
        F.when(F.col("quality") == 0, F.array(F.col("doc_id") + 2)).otherwise(F.array().cast("array<bigint>")).alias("manual"),
    )
    return files.marked_ids(one, ("auto", "manual"), "marks", "wordmark")


@query("SELECT p_partkey, unnest(['default', 'dark']) variant, unnest([concat(p_name, '.svg'), concat(p_name, '-dark.svg')]) file, FALSE wordmark FROM part UNION ALL SELECT p_partkey, 'default', concat(p_name, '-wordmark.svg'), TRUE FROM part WHERE p_size % 2 = 0")
def q_expand_variants(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").select("p_partkey", F.create_map(F.lit("default"), F.concat("p_name", F.lit(".svg")), F.lit("dark"), F.concat("p_name", F.lit("-dark.svg"))).alias("file"), F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("-wordmark.svg"))).alias("wordmark"))
    return files.expanded_variants(items, {"file": False, "wordmark": True}, ("p_partkey",))


@query("SELECT 'customer' source_type, c_custkey id, c_name \"name\", c_acctbal balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT 'part', p_partkey, p_name, NULL FROM part")
def q_union_sources(spark: SparkSession, d: str) -> DataFrame:
    c, s, p = table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "part")
    return files.landed({
        "customer": c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")),
        "supplier": s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        "part": p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")),
    }).select("source_type", "id", "name", "balance")


@query(f"WITH {RECORDS} SELECT concat_ws('_', source, CAST(record_id AS VARCHAR)) corpus_id, title, coalesce(asset, path) preview_file, CASE WHEN asset IS NULL THEN 'raw_only' ELSE 'pending' END review_status, '' AS license FROM r")
def q_adapt_schema(spark: SparkSession, d: str) -> DataFrame:
    return files.adapted(records(spark, d), {
        "corpus_id": F.concat_ws("_", "source", F.col("record_id").cast("string")), "title": F.col("title"), "preview_file": F.coalesce("asset", "path"),
        "review_status": F.when(F.col("asset").isNull(), "raw_only").otherwise("pending"), "license": F.lit(""),
    })


@query("SELECT l_returnflag, count(*) n FROM lineitem GROUP BY l_returnflag")
def q_count_by(spark: SparkSession, d: str) -> DataFrame:
    return analytics.count_by(table(spark, d, "lineitem"), "l_returnflag")


@query("SELECT CASE WHEN l_returnflag IS NOT NULL THEN 'l_returnflag' WHEN l_linestatus IS NOT NULL THEN 'l_linestatus' ELSE 'l_linenumber' END facet, coalesce(l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR)) AS \"value\", count(*) n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber))")
def q_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return analytics.counts_side_by_side(table(spark, d, "lineitem"), ("l_returnflag", "l_linestatus", "l_linenumber"))


@query("SELECT l_shipdate ship_date, count(*) total, count(*) FILTER (l_returnflag = 'N') converted, count(*) FILTER (l_returnflag = 'R') failed, count(*) FILTER (l_quantity > 40) large FROM lineitem GROUP BY l_shipdate")
def q_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_shipdate").alias("ship_date")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_returnflag") == "N").alias("converted"), F.count_if(F.col("l_returnflag") == "R").alias("failed"), F.count_if(F.col("l_quantity") > 40).alias("large"))


@query("SELECT p_type, p_size, count(*) n, count(*) >= 4 ready FROM part GROUP BY ALL")
def q_group_ready(spark: SparkSession, d: str) -> DataFrame:
    return analytics.count_by(table(spark, d, "part"), "p_type", "p_size").withColumn("ready", F.col("n") >= fixed.GROUP_MINIMUM)


@query("""WITH c AS (SELECT l_partkey, count(*) n, bool_or(l_returnflag = 'R') ok FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey), j AS (SELECT p_partkey, p_brand, n, ok FROM part LEFT JOIN c ON p_partkey = l_partkey)
SELECT p_brand, count(*) total, count(n) covered, count(*) FILTER (ok) approved, count(*) FILTER (n IS NULL) missing_count, coalesce(string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) FILTER (n IS NULL), '') missing, floor(count(n) / count(*) * 1000 + 0.5) / 1000 ratio, count(*) FILTER (ok) >= 4 playable FROM j GROUP BY p_brand""")
def q_group_coverage(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_quantity > 45").withColumnRenamed("l_partkey", "p_partkey")
    out = analytics.coverage(table(spark, d, "part"), lines, "p_partkey", "p_brand", F.col("l_returnflag") == "R")
    return out.withColumn("missing", F.array_join("missing", ","))


@query("SELECT l_linestatus, count(*) files, sum(l_quantity) FILTER (l_returnflag = 'R') raw, sum(l_quantity) FILTER (l_returnflag = 'N') webp FROM lineitem GROUP BY l_linestatus")
def q_size_by_category(spark: SparkSession, d: str) -> DataFrame:
    size = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("files"), size("R").alias("raw"), size("N").alias("webp"))


@query("WITH t AS (SELECT count(*) files, CAST(sum(n_chars) AS BIGINT) total FROM documents), a AS (SELECT *, CAST(floor(total / files + 0.5) AS BIGINT) average FROM t) SELECT *, average * 300 AS projected, total > 20000000 AS over, average * 300 > 20000000 AS projected_over FROM a")
def q_budget_report(spark: SparkSession, d: str) -> DataFrame:
    return analytics.budget(table(spark, d, "documents"), "n_chars", 20_000_000)


@query(f"WITH {ANSWERS}, {GROUPED} SELECT * FROM g")
def q_group_stats(spark: SparkSession, d: str) -> DataFrame:
    return analytics.group_stats(answers(spark, d), "grp")


@query(f"WITH {ANSWERS} SELECT min(latency) FILTER (correct) fastest, min_by(event_type, (latency, event_id)) FILTER (correct) fastest_label, max(latency) slowest, min_by(event_type, (-latency, event_id)) slowest_label FROM w")
def q_core_metrics(spark: SparkSession, d: str) -> DataFrame:
    return analytics.core_metrics(answers(spark, d), "event_type", order="event_id")


@query(f"""WITH {ANSWERS}, {GROUPED}, s AS (SELECT * FROM g WHERE total >= 4), t AS (SELECT * FROM s ORDER BY accuracy DESC, total DESC, grp LIMIT 6)
SELECT grp, total, accuracy, grp = (SELECT grp FROM s ORDER BY accuracy DESC, total DESC, grp LIMIT 1) is_best, grp = (SELECT grp FROM s ORDER BY accuracy, grp LIMIT 1) AND (SELECT min(accuracy) FROM s) < 60 is_weakest, grp = (SELECT grp FROM s ORDER BY mean_latency, grp LIMIT 1) is_fastest FROM t""")
def q_insights(spark: SparkSession, d: str) -> DataFrame:
    return analytics.insights(analytics.group_stats(answers(spark, d), "grp"), "grp")


@query(f"WITH {ANSWERS} SELECT event_id, coalesce(p_name, concat('#', k)) answer_name, coalesce(grp, {fixed.DEFAULT_GROUP!r}) AS grp FROM w LEFT JOIN part ON p_partkey = k AND k >= 10 WHERE NOT correct")
def q_wrong_answers(spark: SparkSession, d: str) -> DataFrame:
    wrong = answers(spark, d).where(~F.col("correct")).join(table(spark, d, "part").select(F.col("p_partkey").alias("pk"), "p_name").where("pk >= 10"), F.col("k") == F.col("pk"), "left")
    return wrong.select("event_id", F.coalesce("p_name", F.concat(F.lit("#"), "k")).alias("answer_name"), keys.first_filled(F.col("grp"), F.lit(fixed.DEFAULT_GROUP)).alias("grp"))


@query(f"WITH {ANSWERS} SELECT user_id, count(*) total, count(*) FILTER (correct) score, CAST(floor(count(*) FILTER (correct) / count(*) * 100 + 0.5) AS BIGINT) accuracy, array_to_string((list(k ORDER BY event_id))[1:1000], ',') records FROM w GROUP BY user_id")
def q_session_result(spark: SparkSession, d: str) -> DataFrame:
    s = analytics.sessions(answers(spark, d), "user_id", ("event_id", "k"))
    return s.withColumn("records", F.array_join(F.transform("records", lambda r: r["k"].cast("string")), ","))


@query(f"WITH {ANSWERS}, s AS (SELECT user_id, event_type, count(*) total, floor(count(*) FILTER (correct) / count(*) * 100 + 0.5) accuracy FROM w GROUP BY ALL) SELECT user_id, count(*) finished, CAST(max(accuracy) AS BIGINT) best_accuracy FROM s GROUP BY user_id")
def q_lifetime_stats(spark: SparkSession, d: str) -> DataFrame:
    played = answers(spark, d).withColumn("session", F.struct("user_id", "event_type"))
    return analytics.session_totals(played, "session").groupBy("session.user_id").agg(F.count(F.lit(1)).alias("finished"), F.max("accuracy").alias("best_accuracy"))


@query(f"WITH {ANSWERS} SELECT event_id, row_number() OVER p n, CAST(sum(CAST(correct AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) score, CAST(floor(row_number() OVER p / count(*) OVER (PARTITION BY user_id) * 100 + 0.5) AS BIGINT) progress FROM w WINDOW p AS (PARTITION BY user_id ORDER BY event_id)")
def q_running_score(spark: SparkSession, d: str) -> DataFrame:
    return analytics.running_score(answers(spark, d), "user_id", "event_id", kept).select("event_id", F.col("n").cast("long").alias("n"), "score", "progress")


@query("SELECT count(*) total, count(*) FILTER (event_type = 'click') clicks, count(*) FILTER (event_type = 'view') AS views FROM events")
def q_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "view").alias("views"))


@query("SELECT c_custkey, count(o_orderkey) candidates, count(*) FILTER (o_orderstatus = 'P') error_count, coalesce(string_agg(concat('order ', o_orderkey), '; ' ORDER BY concat('order ', o_orderkey)) FILTER (o_orderstatus = 'P'), '') errors FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def q_collect_report(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    failed = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("order "), "o_orderkey"))
    return analytics.collection_report(table(spark, d, "customer"), orders, "c_custkey", failed).withColumn("errors", F.array_join("errors", "; "))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def q_top_k(spark: SparkSession, d: str) -> DataFrame:
    return analytics.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 30, F.col("o_totalprice").desc(), F.col("o_orderkey"))


@query("SELECT l_partkey, count(*) n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 25")
def q_priority_review(spark: SparkSession, d: str) -> DataFrame:
    return analytics.top_k(analytics.count_by(table(spark, d, "lineitem"), "l_partkey"), 25, F.col("n").desc(), F.col("l_partkey"))


@query(r"""WITH n AS (SELECT count(*) OVER (PARTITION BY c_name) dup, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) members, * FROM customer),
e AS (SELECT c_custkey, unnest([CASE WHEN NOT regexp_matches(replace(lower(c_name), '#', '_'), '^[a-z0-9]+(_[a-z0-9]+)*$') THEN 'id_pattern' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'group_filled' END, CASE WHEN c_acctbal < 0 THEN 'tri_state' END, CASE WHEN dup > 1 THEN 'unique_id' END, CASE WHEN members < 4 THEN 'group_minimum' END]) error FROM n) SELECT c_custkey, error FROM e WHERE error IS NOT NULL""")
def q_validate_seed(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    counted = c.join(c.groupBy("c_name").agg(F.count(F.lit(1)).alias("dup")), "c_name").join(c.groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("members")), ["c_mktsegment", "c_nationkey"])
    checks = [
        ("id_pattern", F.replace(F.lower("c_name"), F.lit("#"), F.lit("_")).rlike("^[a-z0-9]+(_[a-z0-9]+)*$")), ("group_filled", F.col("c_mktsegment") != "MACHINERY"), ("tri_state", F.col("c_acctbal") >= 0),
        ("unique_id", F.col("dup") == 1), ("group_minimum", F.col("members") >= fixed.GROUP_MINIMUM),
    ]
    return counted.select("c_custkey", F.explode(rules.failed_rules(checks)).alias("error"))


@query(SHARED + """, c AS (SELECT e.entity_id, count(record_id) n FROM (SELECT DISTINCT p_name entity_id FROM part WHERE p_size <= 25) e LEFT JOIN hit h ON e.entity_id = h.entity_id GROUP BY e.entity_id)
SELECT count(*) total, count(*) FILTER (n > 0) matched, count(*) FILTER (n = 0) unmatched, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n = 0) = 0 AS valid FROM c""")
def q_report(spark: SparkSession, d: str) -> DataFrame:
    per = entities(spark, d).join(sharing(spark, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")), "entity_id", "left")
    out = per.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n") > 0).alias("matched"), F.count_if(F.col("n").isNull()).alias("unmatched"), F.sum("n").alias("rows"))
    return out.withColumn("valid", F.col("unmatched") == 0)


# items: an entity is a part, its group type and size, its category the type

RING = """
p AS (SELECT p_partkey e, concat(p_type, '/', p_size) g1, p_type g2, '' g3, md5(concat('ring#', p_partkey)) h FROM part),
t AS (SELECT e, unnest([0, 1, 2]) tier, unnest([g1, g2, g3]) g, h FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY tier, g ORDER BY h) - 1 r, count(*) OVER (PARTITION BY tier, g) n FROM t),
c AS (SELECT a.e answer, b.e opt, a.tier, s.d FROM k a, (SELECT unnest([1, 2, 3]) d) s, k b WHERE s.d <= a.n - 1 AND b.tier = a.tier AND b.g = a.g AND b.r = (a.r + s.d) % a.n),
f AS (SELECT answer, opt, min(tier * 10 + d) o FROM c GROUP BY ALL),
x AS (SELECT answer, opt, row_number() OVER (PARTITION BY answer ORDER BY o) rn FROM f),
o AS (SELECT answer, list(opt) os FROM x WHERE rn <= 3 GROUP BY answer HAVING count(*) = 3),
u AS (SELECT answer, unnest(list_append(os, answer)) opt FROM o),
i0 AS (SELECT answer, list(opt ORDER BY md5(concat(answer, '#', opt))) options FROM u GROUP BY answer),
i AS (SELECT concat(ty, '_', answer) item_id, ty AS "type", answer, options, concat(p_type, '/', p_size) item_group, p_type category FROM i0 JOIN part ON p_partkey = answer, (SELECT unnest(['logo_to_brand', 'brand_to_logo']) ty))"""


def bank(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_type", "p_size").alias("g"), "p_type")
    return itembank.item_bank(part, "p_partkey", "g", "p_type")


@query(f"WITH {RING} SELECT item_id, \"type\", answer, array_to_string(options, ',') options, item_group, category FROM i")
def q_item_bank(spark: SparkSession, d: str) -> DataFrame:
    return bank(spark, d).select("item_id", "type", "answer", F.array_join(F.transform("options", lambda x: x.cast("string")), ",").alias("options"), "item_group", "category")


@query(f"WITH {RING} SELECT item_id FROM i")
def q_valid_items(spark: SparkSession, d: str) -> DataFrame:
    return bank(spark, d).where(itembank.is_valid_item()).select("item_id")


@query(f"""WITH {RING}, n AS (SELECT item_id, answer, unnest(options) opt, generate_subscripts(options, 1) pos FROM i)
SELECT item_id, string_agg(concat(chr(64 + CAST(pos AS INT)), ':', p_name, CASE WHEN opt = answer THEN '*' ELSE '' END), '|' ORDER BY pos) shown FROM n JOIN part ON p_partkey = opt GROUP BY item_id""")
def q_item_denorm(spark: SparkSession, d: str) -> DataFrame:
    named = itembank.with_names(bank(spark, d), table(spark, d, "part"), "p_partkey", "p_name")
    return named.select("item_id", F.array_join(F.transform("options", lambda o: F.concat(o["letter"], F.lit(":"), o["option_name"], F.when(o["correct"], "*").otherwise(""))), "|").alias("shown"))


@query(f"""WITH {RING}, n AS (SELECT item_id, answer, unnest(options) opt FROM i), g AS (SELECT item_id, count(DISTINCT lower(p_name)) < count(*) same, max(CASE WHEN opt = answer THEN p_name END) an FROM n JOIN part ON p_partkey = opt GROUP BY item_id)
SELECT item_id, concat_ws(',', CASE WHEN same THEN 'same_names' END, CASE WHEN regexp_matches(an, '(?i)^[a-z0-9_]{{12,}}$') THEN 'id_like' END) risks FROM g""")
def q_item_risk(spark: SparkSession, d: str) -> DataFrame:
    named = itembank.with_names(bank(spark, d), table(spark, d, "part"), "p_partkey", "p_name")
    return named.select("item_id", F.array_join(itembank.item_risks(), ",").alias("risks"))


# items with every kind of fault: options cut or repeated, unknown answers, other suffixes, blank names
FAULTS = f"""{RING}, j AS (SELECT item_id, CASE WHEN answer % 17 = 0 THEN 'quiz' ELSE "type" END ty, answer, CASE WHEN answer % 7 = 0 THEN options[1:3] WHEN answer % 11 = 0 THEN list_append(options[1:3], options[1]) ELSE options END os, CASE WHEN answer % 13 = 0 THEN ' ' ELSE p_name END nm, p_size FROM i JOIN part ON p_partkey = answer),
e AS (SELECT item_id, unnest([CASE WHEN ty NOT IN ('logo_to_brand', 'brand_to_logo') THEN 'invalid_type' END, CASE WHEN p_size >= 40 THEN 'answer_missing' END, CASE WHEN len(os) <> 4 THEN 'option_count_not_4' END, CASE WHEN len(list_distinct(os)) <> len(os) THEN 'duplicate_options' END,
  CASE WHEN NOT list_contains(os, answer) THEN 'answer_not_in_options' END, CASE WHEN (ty = 'brand_to_logo' AND len(list_filter(os, lambda x: x % 9 = 0)) > 0) OR (ty <> 'brand_to_logo' AND answer % 9 = 0) THEN 'invalid_url' END, CASE WHEN trim(nm) = '' THEN 'blank_name' END]) error FROM j), bad AS (SELECT * FROM e WHERE error IS NOT NULL)"""


@query(f"WITH {FAULTS} SELECT * FROM bad")
def q_validate_items(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("answer")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("pk"), "p_name", "p_size")
    items = bank(spark, d).join(part.hint("merge"), k == F.col("pk")).withColumn("type", F.when(k % 17 == 0, "quiz").otherwise(F.col("type")))
    three = F.slice("options", 1, 3)
    items = items.withColumn("options", F.when(k % 7 == 0, three).when(k % 11 == 0, F.concat(three, F.slice("options", 1, 1))).otherwise(F.col("options")))
    image = lambda o: F.concat(F.lit("https://assets.example.com/logos/"), o.cast("string"), F.when(o % 9 == 0, ".png").otherwise(".jpg"))
    checks = itembank.item_checks(F.col("p_size") < 40, F.when(k % 13 == 0, " ").otherwise(F.col("p_name")), itembank.item_images(image), "https://assets.example.com/logos/")
    return items.select("item_id", F.explode(rules.failed_rules(checks)).alias("error"))


@query(f"""WITH {FAULTS}, c300 AS (SELECT * FROM bad ORDER BY item_id, error LIMIT 300), gs AS (SELECT item_group, count(*) n FROM i GROUP BY 1)
SELECT (SELECT count(*) FROM bad) error_count, (SELECT count(*) FROM bad) = 0 AS valid, (SELECT string_agg(concat(item_id, ':', error), '|' ORDER BY item_id, error) FROM c300) errors, (SELECT count(*) FROM i) items, (SELECT count(*) FROM gs) groups, (SELECT min(n) FROM gs) smallest_group""")
def q_error_report(spark: SparkSession, d: str) -> DataFrame:
    """One row: the true number of errors, 300 of them, and statistics of the groups."""
    report = rules.capped_errors(q_validate_items(spark, d), ("item_id", "error"))
    stats = analytics.count_by(bank(spark, d), "item_group").agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("groups"), F.min("n").alias("smallest_group"))
    joined = report.withColumn("one", F.lit(1)).join(stats.withColumn("one", F.lit(1)), "one")  # a row each
    return joined.select("error_count", "valid", F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["item_id"], e["error"])), "|").alias("errors"), "items", "groups", "smallest_group")


@query(f"""WITH {RING}, p0 AS (SELECT * REPLACE (category AS answer) FROM i), o1 AS (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY md5(concat('s3#', item_id)), item_id) k FROM p0),
t1 AS (SELECT item_id, category, row_number() OVER (PARTITION BY category ORDER BY md5(concat('s3#', item_id)), item_id) turn FROM o1 WHERE k = 1), a1 AS (SELECT item_id, turn FROM t1 ORDER BY turn, md5(concat('s3#', category)), category LIMIT 20)
SELECT item_id, turn FROM (SELECT item_id, turn, 0 z, '' m FROM a1 UNION ALL SELECT item_id, NULL, 1, md5(concat('s3#', item_id)) FROM p0 WHERE item_id NOT IN (SELECT item_id FROM a1)) ORDER BY z, m, item_id LIMIT 20""")
def q_balanced_refill(spark: SparkSession, d: str) -> DataFrame:
    """A balanced pick where the answers are the few categories, which their other items fill up."""
    return itembank.balanced_pick(bank(spark, d).withColumn("answer", F.col("category")), fixed.ROUND_SIZE, "s3").select("item_id", F.col("turn").cast("long").alias("turn"))


@query(f"WITH {RING} SELECT item_id, CASE WHEN \"type\" = 'brand_to_logo' THEN '反向记忆' ELSE '基础识别' END \"label\" FROM i")
def q_type_label(spark: SparkSession, d: str) -> DataFrame:
    return bank(spark, d).select("item_id", keys.type_label(F.col("type")).alias("label"))


@query("""WITH r AS (SELECT o_orderpriority grp, o_orderstatus = 'F' OR o_orderstatus = 'O' conv, o_totalprice * 3 bytes, o_orderkey FROM orders), m AS (SELECT o_orderpriority grp, count(DISTINCT o_orderkey) matched FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND o_orderpriority < '4' GROUP BY 1)
SELECT r.grp, count(*) FILTER (conv) converted, count(*) FILTER (NOT conv) failed, count(*) FILTER (conv AND bytes > 524288) large_files, coalesce(max(matched), 0) matched FROM r LEFT JOIN m ON r.grp = m.grp GROUP BY r.grp""")
def q_conversion_report(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "grp")
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    matches = orders.where("grp < '4'").join(returned, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("grp").agg(F.count(F.lit(1)).alias("matched"))
    status = F.when(F.col("o_orderstatus").isin("F", "O"), "converted").otherwise("download_failed")
    return analytics.conversion_report(orders, "grp", status, F.col("o_totalprice") * 3, matches)


@query("SELECT event_id, replace(replace(concat('{\"t\":\"<b>', event_type, chr(8232), '</b>\"}'), '<', '\\u003c'), chr(8232), '\\u2028') escaped FROM events")
def q_json_escape(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('{"t":"<b>'), "event_type", F.lit('\u2028</b>"}'))
    return table(spark, d, "events").select("event_id", keys.json_script_escaped(text).alias("escaped"))


@query(f"WITH {RING} SELECT item_id, answer FROM i ORDER BY md5(concat('s1#', item_id)), item_id LIMIT 20")
def q_sample_items(spark: SparkSession, d: str) -> DataFrame:
    return itembank.sample_items(bank(spark, d), fixed.ROUND_SIZE, "s1").select("item_id", "answer")


TURNS = "row_number() OVER (PARTITION BY category ORDER BY md5(concat('s2#', item_id)), item_id)"


@query(f"WITH {RING}, b AS (SELECT *, {TURNS} turn FROM i WHERE \"type\" = 'logo_to_brand') SELECT item_id, turn FROM b ORDER BY turn, md5(concat('s2#', category)), category LIMIT 20")
def q_balanced_pick(spark: SparkSession, d: str) -> DataFrame:
    return itembank.balanced_pick(bank(spark, d).where("type = 'logo_to_brand'"), fixed.ROUND_SIZE, "s2").select("item_id", F.col("turn").cast("long").alias("turn"))


@query(f"""WITH {RING}, a0 AS (SELECT *, {TURNS} turn FROM i WHERE "type" = 'logo_to_brand'), a AS (SELECT *, row_number() OVER (ORDER BY turn, md5(concat('s2#', category)), category) place FROM a0 ORDER BY place LIMIT 10),
b0 AS (SELECT *, {TURNS} turn FROM i WHERE "type" = 'brand_to_logo' AND answer NOT IN (SELECT answer FROM a)), b AS (SELECT *, row_number() OVER (ORDER BY turn, md5(concat('s2#', category)), category) place FROM b0 ORDER BY place LIMIT 10)
SELECT item_id, place FROM a UNION ALL SELECT item_id, place FROM b""")
def q_mixed_pick(spark: SparkSession, d: str) -> DataFrame:
    return itembank.mixed_pick(bank(spark, d), fixed.ROUND_SIZE, "s2", "logo_to_brand", "brand_to_logo").select("item_id", F.col("place").cast("long").alias("place"))


@query("WITH s AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5(concat(p_brand, '#', p_partkey))) \"place\" FROM part) SELECT * FROM s")
def q_stable_shuffle(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand").withColumn("h", itembank.hash_order(F.col("p_brand"), F.col("p_partkey")))
    return analytics.ranked_by(part, "p_brand", "h", kept).select("p_partkey", "p_brand", F.col("rank").cast("long").alias("place"))


# the generator step by step, each step a swap of two list elements
LCG = """WITH RECURSIVE g AS (SELECT p_brand, list(p_partkey ORDER BY p_partkey) parts FROM part GROUP BY p_brand),
s(p_brand, i, st, parts) AS (SELECT p_brand, CAST(len(parts) AS BIGINT), CAST(length(p_brand) AS BIGINT), parts FROM g UNION ALL
SELECT p_brand, i - 1, nx, list_transform(parts, lambda x, k: CASE WHEN k = i THEN parts[nx % i + 1] WHEN k = nx % i + 1 THEN parts[i] ELSE x END) FROM (SELECT *, (st * 1664525 + 1013904223) % 4294967296 nx FROM s WHERE i > 1))"""


@query(LCG + """ SELECT p_brand, unnest(range(1, len(parts) + 1)) "place", unnest(parts) p_partkey FROM s WHERE i <= 1""")
def q_lcg_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """The order of every brand's parts that the seeded generator gives."""
    return itembank.lcg_shuffle(table(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", F.length("p_brand")).select("p_brand", "place", "p_partkey")
