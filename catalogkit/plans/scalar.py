"""Queries of the scalar functions (names, keys, URLs, formats)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogkit.functions import fixed, keys
from catalogkit.plans.registry import query, table

NORM = "regexp_replace(lower(coalesce({}, '')), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')"
SLUG = "coalesce(nullif(substr(regexp_replace(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80), ''), 'item')"
HOST = "regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace(trim(coalesce({0}, '')), '^(?i)https?://', ''), '^([^/?#]*)', 1), '^[^@]*@', ''), ':\\d+$', '')), '^www\\.', '')"
SPACED = "trim(regexp_replace(regexp_replace(regexp_replace(coalesce({}, ''), '(?i)\\.(svg|png|jpe?g|webp)$', ''), '[-_]+', ' ', 'g'), '\\s+', ' ', 'g'))"
CAPS = "array_to_string(list_transform(regexp_extract_all({}, '([A-Za-z0-9_]+|[^A-Za-z0-9_]+)', 1), lambda r: CASE WHEN regexp_matches(r, '^[a-z]') THEN concat(upper(substr(r, 1, 1)), substr(r, 2)) ELSE r END), '')"


def words_rule(words: tuple[str, ...]) -> str:
    return rf"\b({'|'.join(words)})\b"


@query("SELECT c_custkey, coalesce(nullif(trim(regexp_extract(c_name, '#(0*)([1-9].*)?$', 2)), ''), nullif(trim(c_mktsegment), ''), 'none') filled FROM customer")
def q_falsy_coalesce(spark: SparkSession, d: str) -> DataFrame:
    number = F.regexp_extract("c_name", "#(0*)([1-9].*)?$", 2)
    return table(spark, d, "customer").select("c_custkey", keys.first_filled(number, F.col("c_mktsegment"), F.lit("none")).alias("filled"))


@query(f"SELECT doc_id, {NORM.format('text')} with_cjk, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') ascii_only FROM documents")
def q_norm_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", keys.norm_key(F.col("text")).alias("with_cjk"), keys.norm_key(F.col("text"), False).alias("ascii_only"))


@query(f"SELECT p_partkey, {SLUG.format('p_brand')} brand_slug, concat_ws('_', lower(p_type), CAST(p_partkey AS VARCHAR), {SLUG.format('p_name')}) candidate_id FROM part")
def q_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", keys.slug(F.col("p_brand")).alias("brand_slug"), keys.composite_id(F.lower("p_type"), F.col("p_partkey").cast("string"), F.col("p_name")).alias("candidate_id"))


@query(f"SELECT page_id, {HOST.format('url')} host, {HOST.format('concat(url, chr(32))')} trimmed FROM pages")
def q_norm_domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", keys.host(F.col("url")).alias("host"), keys.host(F.concat("url", F.lit(" "))).alias("trimmed"))


@query(f"SELECT page_id, concat('https://cdn.example.com/', {HOST.format('url')}, '/icon?c=key') asset, concat('https://cdn.example.com/', {HOST.format('url')}, '/icon?c=***') masked FROM pages")
def q_url_template(spark: SparkSession, d: str) -> DataFrame:
    asset = keys.url_for("https://cdn.example.com/%s/icon?c=key", F.col("url"))
    return table(spark, d, "pages").select("page_id", asset.alias("asset"), keys.masked(asset).alias("masked"))


@query(r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^(https?:)', 1) scheme, regexp_extract(url, '^(https?://[^/?#]*)', 1) root, regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[^/]*$', '') folder FROM pages)
SELECT page_id, concat(root, '/a.svg') rooted, concat(scheme, '//cdn.example.com/b.png') schemeless, concat(root, CASE WHEN folder = '' THEN '/' ELSE folder END, 'c.png') relative, url AS same, '' AS blank FROM p""")
def q_abs_url(spark: SparkSession, d: str) -> DataFrame:
    u, one = F.col("url"), lambda x: keys.absolute_url(F.col("url"), F.lit(x))
    return table(spark, d, "pages").select("page_id", one("/a.svg").alias("rooted"), one("//cdn.example.com/b.png").alias("schemeless"), one("c.png").alias("relative"), keys.absolute_url(u, u).alias("same"), one("").alias("blank"))


@query("""
WITH t AS (SELECT p_partkey, ['image/svg+xml', 'image/PNG', 'image/jpeg', 'image/webp', 'image/x-icon', 'text/html', NULL][p_partkey % 7 + 1] ct, concat('https://x.example.com/', replace(p_name, ' ', '-'), CASE WHEN p_size % 2 = 0 THEN '.Gif?v=1' ELSE '' END) url FROM part)
SELECT p_partkey, CASE WHEN lower(ct) LIKE '%svg%' THEN 'svg' WHEN lower(ct) LIKE '%png%' THEN 'png' WHEN lower(ct) LIKE '%jpeg%' THEN 'jpg' WHEN lower(ct) LIKE '%webp%' THEN 'webp' WHEN lower(ct) LIKE '%icon%' THEN 'ico' WHEN url LIKE '%.Gif%' THEN 'gif' ELSE 'bin' END format FROM t""")
def q_format_from(spark: SparkSession, d: str) -> DataFrame:
    types = F.array(*map(F.lit, ("image/svg+xml", "image/PNG", "image/jpeg", "image/webp", "image/x-icon", "text/html")), F.lit(None).cast("string"))
    url = F.concat(F.lit("https://x.example.com/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.when(F.col("p_size") % 2 == 0, ".Gif?v=1").otherwise(""))
    return table(spark, d, "part").select("p_partkey", keys.media_format(url, F.get(types, (F.col("p_partkey") % 7).cast("int"))).alias("format"))


@query("SELECT p_partkey, greatest(p_size, p_size * 7 % 50) side, 0 AS none FROM part")
def q_parse_size(spark: SparkSession, d: str) -> DataFrame:
    size = F.concat(F.lit("any "), F.col("p_size"), F.lit("x"), F.col("p_size") * 7 % 50, F.lit(" 1x1"))
    return table(spark, d, "part").select("p_partkey", keys.largest_side(size).alias("side"), keys.largest_side(F.col("p_name")).alias("none"))


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') u FROM pages)
SELECT page_id, list_extract(string_split(u, '/'), -1) base, lower(regexp_extract(list_extract(string_split(u, '/'), -1), '[^.]\.([^.]*)$', 1)) ext, lower(replace(concat('C:\Data\', list_extract(string_split(u, '/'), -1)), '\', '/')) path FROM p""")
def q_path_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, d, "pages").select("page_id", keys.basename(u).alias("base"), keys.extension(u).alias("ext"), keys.clean_path(F.concat(F.lit("C:\\Data\\"), keys.basename(u))).alias("path"))


@query(rf"""
WITH n AS (SELECT p_partkey, concat(replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE '-' END), ['-icon.svg', ' logo', '''s', '.PNG', ''][p_partkey % 5 + 1]) raw FROM part),
s AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(raw), '(?i)\.(svg|png|jpe?g|webp)$', ''), '(?i)(?:^|[-_\s])(icon|logo|default|color|black|white|symbol|mark)$', ''), '[-_]+', ' ', 'g'), '\s+', ' ', 'g')) t FROM n)
SELECT p_partkey, {CAPS.format('t')} shown, concat(' ', {CAPS.format('t')}, ' ') prompt FROM s""")
def q_clean_name(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    tail = F.get(F.array(*map(F.lit, ("-icon.svg", " logo", "'s", ".PNG", ""))), (k % 5).cast("int"))
    raw = F.concat(F.replace("p_name", F.lit(" "), F.when(k % 2 == 0, "_").otherwise("-")), tail)
    return table(spark, d, "part").select("p_partkey", keys.clean_name(raw).alias("shown")).withColumn("prompt", keys.prompt_name(F.col("shown")))


@query("SELECT o_orderkey, trim(split_part(concat(' ', o_orderpriority, ' ; ', o_orderstatus), ';', 1)) token FROM orders")
def q_note_token(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", keys.note_token(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ; "), "o_orderstatus")).alias("token"))


@query(rf"""
WITH n AS (SELECT p_partkey, p_name AS display, lower(p_type) || ['bank', 'cloud', 'x'][p_partkey % 3 + 1] AS entity FROM part),
f AS (SELECT p_partkey, [display, NULL, concat(display, ' brand'), concat(display, ' company'), regexp_replace({SPACED.format('display')}, '(?i)({"|".join(fixed.GLUED_SUFFIXES)})$', ' \1'), entity,
        regexp_replace({SPACED.format('entity')}, '(?i)({"|".join(fixed.GLUED_SUFFIXES)})$', ' \1'), entity] forms FROM n),
c AS (SELECT p_partkey, list_filter(list_transform(forms, lambda x: {SPACED.format('x')}), lambda x: x <> '') fs FROM f)
SELECT p_partkey, array_to_string(list_slice(list_filter(fs, lambda x, i: list_position(fs, x) = i), 1, 4), '|') queries FROM c""")
def q_query_variants(spark: SparkSession, d: str) -> DataFrame:
    entity = F.concat(F.lower("p_type"), F.get(F.array(*map(F.lit, ("bank", "cloud", "x"))), (F.col("p_partkey") % 3).cast("int")))
    return table(spark, d, "part").select("p_partkey", F.array_join(keys.query_forms(entity, F.lit(None).cast("string"), F.col("p_name")), "|").alias("queries"))


def _when(c: str, table: dict, default: str) -> str:
    return f"CASE {' '.join(f'WHEN {c} = {k!r} THEN {v!r}' for k, v in table.items())} ELSE {default} END"


@query(f"""
WITH t AS (SELECT p_partkey, ['aigc', 'airline', 'pay', 'tools', 'weather', 'none'][p_partkey % 6 + 1] raw, ['car-logos', 'thesvg', 'wikimedia', 'svglogo'][p_partkey % 4 + 1] src FROM part)
SELECT p_partkey, {_when('raw', fixed.CATEGORY_NAMES, 'raw')} category, {_when('src', fixed.SOURCE_CATEGORY, repr(fixed.DEFAULT_CATEGORY))} by_source FROM t""")
def q_category_map(spark: SparkSession, d: str) -> DataFrame:
    raw = F.get(F.array(*map(F.lit, ("aigc", "airline", "pay", "tools", "weather", "none"))), (F.col("p_partkey") % 6).cast("int"))
    src = F.get(F.array(*map(F.lit, ("car-logos", "thesvg", "wikimedia", "svglogo"))), (F.col("p_partkey") % 4).cast("int"))
    out = table(spark, d, "part").select("p_partkey", raw.alias("raw"), src.alias("src"))
    named = keys.mapped(F.col("raw"), fixed.CATEGORY_NAMES, None)
    return out.select("p_partkey", F.coalesce(named, "raw").alias("category"), keys.mapped(F.col("src"), fixed.SOURCE_CATEGORY, fixed.DEFAULT_CATEGORY).alias("by_source"))


@query(f"SELECT doc_id, CASE {' '.join(f'WHEN regexp_matches(lower(text), {words_rule(w)!r}) THEN {n!r}' for w, n in fixed.KEYWORD_CATEGORIES)} ELSE '' END category FROM documents".replace("\\\\b", "\\b"))
def q_keyword_class(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", keys.category_by_words(F.col("text")).alias("category"))


@query("""SELECT o_orderkey, printf('%.2f MB', o_totalprice * 100 / 1048576.0) megabytes, printf('%.2fs', o_orderkey / 100.0) secs, CAST(floor(o_totalprice / 5000.0 + 0.5) AS BIGINT) pct FROM orders""")
def q_format_metrics(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", keys.megabytes(price * 100).alias("megabytes"), keys.seconds(F.col("o_orderkey"), 100.0).alias("secs"), keys.half_up(price / 5000.0).alias("pct"))


@query("""SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') escaped FROM pages""")
def q_html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", keys.html_escaped(F.col("html")).alias("escaped"))


@query("""
SELECT p_partkey, CASE WHEN p_size * 2 >= 90 THEN 'master' WHEN p_size * 2 >= 75 THEN 'expert' WHEN p_size * 2 >= 60 THEN 'skilled' WHEN p_size * 2 >= 40 THEN 'learner' ELSE 'novice' END title,
  CASE WHEN p_size * 2 >= 75 THEN 'green' WHEN p_size * 2 >= 50 THEN 'orange' ELSE 'red' END comment,
  CASE WHEN p_type = 'SMALL' THEN 'name the mark' WHEN p_type = 'LARGE' THEN 'pick the mark' ELSE 'other' END type_label,
  CASE WHEN p_name LIKE '%ring%' THEN 45 WHEN p_name LIKE '%bolt%' THEN 76 ELSE 60 END file_score FROM part""")
def q_score_band(spark: SparkSession, d: str) -> DataFrame:
    score = F.col("p_size") * 2
    by_name = keys.first_class(F.col("p_name"), (("ring", 45), ("bolt", 76)), 60)
    label = keys.mapped(F.col("p_type"), {"SMALL": "name the mark", "LARGE": "pick the mark"}, "other")
    return table(spark, d, "part").select("p_partkey", keys.banded(score, fixed.SCORE_TITLES, "novice").alias("title"), keys.banded(score, ((75, "green"), (50, "orange")), "red").alias("comment"), label.alias("type_label"), by_name.alias("file_score"))


@query("""
WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN upper(substr(replace(p_name, ' ', ''), 1, 1)) || substr(replace(p_name, ' ', ''), 2) WHEN p_partkey % 4 = 1 THEN '' ELSE p_name END shown, CASE WHEN p_partkey % 4 = 2 THEN replace(p_name, ' ', '_') ELSE lower(p_brand) END entity FROM part)
SELECT p_partkey, CASE WHEN trim(shown) = '' THEN TRUE ELSE (regexp_replace(lower(shown), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(entity), '[^a-z0-9]+', '', 'g') AND length(regexp_replace(lower(entity), '[^a-z0-9]+', '', 'g')) >= 7)
  OR (regexp_matches(shown, '^[A-Z][a-z0-9]+$') AND length(shown) >= 9) END generated FROM n""")
def q_machine_name(spark: SparkSession, d: str) -> DataFrame:
    k, joined = F.col("p_partkey"), F.replace("p_name", F.lit(" "), F.lit(""))
    shown = F.when(k % 4 == 0, F.concat(F.upper(F.substring(joined, 1, 1)), F.substring(joined, 2, 100))).when(k % 4 == 1, "").otherwise(F.col("p_name"))
    entity = F.when(k % 4 == 2, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.lower("p_brand"))
    return table(spark, d, "part").select("p_partkey", keys.looks_generated(entity, F.lit(""), shown).alias("generated"))
