"""Queries over web pages, hashes that need rounds, and the answer stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogkit.functions import fixed, keys
from catalogkit.operators import analytics, curate, links
from catalogkit.plans.catalog import NEAR, hashes
from catalogkit.plans.registry import query, table
from catalogkit.sources.shared import kept, shared_path
from catalogkit.streaming import answers


ANCHORS = r"""
t AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)(<a\s[^>]*href=[^>]*>.*?</a>)', 1)) tag, generate_subscripts(regexp_extract_all(html, '(?is)(<a\s[^>]*href=[^>]*>.*?</a>)', 1), 1) - 1 pos FROM pages),
h AS (SELECT *, regexp_extract(tag, '(?i)\shref\s*=\s*["'']([^"'']*)["'']', 1) href, trim(regexp_replace(regexp_replace(tag, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) txt, regexp_extract(url, '^(https?://[^/?#]*)', 1) root FROM t),
a AS (SELECT *, concat(root, href) abs_url FROM h)"""


@query(rf"""WITH {ANCHORS}, k AS (SELECT *, list_extract(list_filter({list(fixed.LINK_KEYWORDS)!r}, lambda x: contains(lower(concat(txt, ' ', href)), x)), 1) keyword FROM a)
SELECT page_id, CAST(pos AS INT) pos, abs_url asset_url, substr(txt, 1, 180) link_text, keyword, CASE {' '.join(f"WHEN contains(lower(concat(abs_url, ' ', txt)), {a!r}) THEN {b!r}" for a, b in fixed.LINK_CLASSES)} ELSE 'unknown' END asset_type,
CASE WHEN contains(keyword, 'brand') OR contains(keyword, 'logo') THEN 'medium' WHEN keyword IS NOT NULL THEN 'low' END confidence FROM k""")
def q_link_discovery(spark: SparkSession, d: str) -> DataFrame:
    return links.page_anchors(table(spark, d, "pages"), "page_id", "url", "html")


ICONS = ("icon", "apple-touch-icon", "mask-icon", "manifest", "stylesheet")


@query(rf"""WITH {ANCHORS}, r AS (SELECT *, {list(ICONS)!r}[CAST((page_id + pos) % 5 AS INT) + 1] rel FROM h)
SELECT page_id, CAST(pos AS INT) pos, CASE rel WHEN 'manifest' THEN 'manifest-link' ELSE rel END kind, concat(root, href) icon_url, CASE WHEN rel IN ('icon', 'apple-touch-icon') THEN 16 * (pos % 4 + 1) ELSE 0 END size,
CASE rel WHEN 'icon' THEN 50 WHEN 'apple-touch-icon' THEN 80 WHEN 'mask-icon' THEN 60 ELSE 10 END priority FROM r WHERE rel <> 'stylesheet'""")
def q_icon_links(spark: SparkSession, d: str) -> DataFrame:
    """Icons that pages declare; each anchor of the driver's pages stands as a link element."""
    tags = table(spark, d, "pages").select("page_id", "url", F.regexp_extract_all("html", F.lit(r"(?is)(<a\s[^>]*href=[^>]*>.*?</a>)"), 1).alias("tags"))
    rel = lambda i: F.get(F.array(*map(F.lit, ICONS)), ((F.col("page_id") + i) % 5).cast("int"))
    size = lambda i: (16 * (i % 4 + 1)).cast("string")
    link = F.transform("tags", lambda t, i: F.concat(F.lit('<link rel="'), rel(i), F.lit('" sizes="'), size(i), F.lit("x"), size(i), F.lit('" href="'), links.attribute(t, "href"), F.lit('">')))
    found = links.icon_links(tags.select("page_id", "url", F.array_join(link, "").alias("html")), "page_id", "url", "html")
    return found.select("page_id", "pos", "kind", "icon_url", F.col("size").cast("long").alias("size"), "priority")


@query(rf"""WITH {ANCHORS} SELECT page_id, CAST(pos AS INT) pos, 'manifest' kind, abs_url icon_url, 128 * (pos % 8 + 1) size, CASE WHEN 128 * (pos % 8 + 1) >= 512 THEN 100 ELSE 85 END priority FROM a""")
def q_manifest_icons(spark: SparkSession, d: str) -> DataFrame:
    """Icons of manifest documents made of the pages' anchors."""
    hrefs = F.regexp_extract_all("html", F.lit(r"(?is)(<a\s[^>]*href=[^>]*>.*?</a>)"), 1)
    side = lambda i: (128 * (i % 8 + 1)).cast("string")
    icons = F.transform(hrefs, lambda t, i: F.struct(links.attribute(t, "href").alias("src"), F.concat(side(i), F.lit("x"), side(i)).alias("sizes")))
    found = links.manifest_icons(table(spark, d, "pages").select("page_id", "url", icons.alias("icons")), "page_id", "url")
    return found.select("page_id", "pos", "kind", "icon_url", F.col("size").cast("long").alias("size"), "priority")


@query(rf"""WITH {ANCHORS}, u AS (SELECT page_id, abs_url, min(pos) pos FROM a GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(abs_url) DESC, pos) "rank" FROM u) SELECT page_id, abs_url icon_url, "rank" FROM r WHERE "rank" <= 4""")
def q_link_rank(spark: SparkSession, d: str) -> DataFrame:
    found = links.page_anchors(table(spark, d, "pages"), "page_id", "url", "html").select("page_id", "pos", F.col("asset_url").alias("icon_url"), F.lit("icon").alias("kind"), F.lit(0).alias("size"), F.length("asset_url").alias("priority"))
    ranked = analytics.top_k_by(links.first_per_url(found, "page_id"), "page_id", 4, F.col("priority").desc(), F.col("pos"))
    return ranked.select("page_id", "icon_url", F.col("rank").cast("long").alias("rank"))


SCORE = " + ".join(f"CASE WHEN contains(lower(tag), {w!r}) THEN {n} ELSE 0 END" for w, n in fixed.ELEMENT_WEIGHTS)


@query(rf"""WITH {ANCHORS}, s AS (SELECT page_id, pos, CASE WHEN contains(lower(tag), 'the') THEN 70 ELSE 0 END + {SCORE} + least(length(txt) + 24, 120) score FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) "rank" FROM s)
SELECT page_id, CAST(pos AS INT) pos, CAST(score AS BIGINT) score, "rank" FROM r WHERE "rank" <= 8""")
def q_element_score(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)(<a\s[^>]*href=[^>]*>.*?</a>)"), 1)).alias("pos", "tag"))
    width = F.length(F.trim(F.regexp_replace(F.regexp_replace("tag", "<[^>]*>", ""), r"\s+", " ")))
    scored = tags.select("page_id", "pos", links.element_score(F.col("tag"), F.lit("the"), width, F.lit(24), F.lit("image")).cast("long").alias("score"))
    return analytics.top_k_by(scored, "page_id", 8, F.col("score").desc(), F.col("pos")).select("page_id", "pos", "score", F.col("rank").cast("long").alias("rank"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'error' WHEN s BETWEEN 300 AND 399 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'hotlink_blocked' ELSE 'redirected' END WHEN s = 404 THEN 'not_found' WHEN s >= 400 OR o_orderkey % 13 = 0 THEN 'download_failed' WHEN o_orderstatus = 'P' THEN 'not_image_response' ELSE 'converted' END status
FROM (SELECT *, [200, 302, 404, 500, 200][o_orderkey % 5 + 1] s FROM orders)""")
def q_fetch_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.get(F.array(*map(F.lit, (200, 302, 404, 500, 200))), (k % 5).cast("int"))
    place = F.when(k % 2 == 0, "https://x.example.com/hotlinking?a=1").otherwise("https://x.example.com/")
    kind = F.when(F.col("o_orderstatus") == "P", "text/html").otherwise("image/png")
    return table(spark, d, "orders").select("o_orderkey", links.fetch_status(status, place, F.when(k % 13 == 0, 0).otherwise(10), kind, k % 17 == 0).alias("status"))


@query(f"""WITH RECURSIVE {NEAR}, l AS (SELECT b, list(a) earlier FROM n4 GROUP BY b), o AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) rn, earlier FROM hb LEFT JOIN l ON b = vec_id),
s(rn, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT o.rn, CASE WHEN coalesce(list_has_any(kept, CAST(earlier AS BIGINT[])), FALSE) THEN kept ELSE list_append(kept, CAST(vec_id AS BIGINT)) END FROM s JOIN o ON o.rn = s.rn + 1)
SELECT vec_id, list_contains((SELECT kept FROM s ORDER BY rn DESC LIMIT 1), CAST(vec_id AS BIGINT)) kept FROM hb""")
def q_near_dup_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Records that a greedy pass over the hashes keeps (4 of 256 bits)."""
    found = curate.near_copies(hashes(spark, d), "vec_id", "code", F.col("vec_id"), F.lit(False), kept)
    return found.select(F.col("id").alias("vec_id"), (F.col("state") == "kept").alias("kept"))


@query("SELECT date_trunc('day', ts) window_start, event_type, count(*) total, count(*) FILTER (CAST(regexp_extract(props, '\"k\": ?(\\d+)', 1) AS INT) % 2 = 0) correct, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) latency FROM events GROUP BY ALL")
def q_stream_group_stats(spark: SparkSession, d: str) -> DataFrame:
    events = answers.read_events(spark, f"{d}/events.parquet")
    right = F.get_json_object("props", "$.k").cast("int") % 2 == 0
    stats = answers.windowed_stats(events.withColumn("latency", F.round(F.col("value") * 100).cast("long")).withColumn("right", right), "ts", "event_type", "right", "latency")
    path = shared_path(spark)
    return answers.run_to_table(stats, f"{path}/table", f"{path}/state")
