"""Queries that write the driver's tables through sinks and read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogkit.operators import resolve, rules
from catalogkit.plans.catalog import RECORDS, records
from catalogkit.plans.registry import query, table
from catalogkit.sources import files, shared

READ = ("svglogo", "thesvg", "wikimedia", "gilbarbara")


@query(f"""WITH {RECORDS}, g AS (SELECT * FROM r WHERE source IN {READ!r})
SELECT source, count(*) n, count(*) FILTER (size % 11 = 0) corrupt, sum(record_id) FILTER (size % 11 <> 0) ids, count(asset) FILTER (size % 11 <> 0 AND source <> 'wikimedia') assets, sum(size) FILTER (size % 11 <> 0 AND source = 'wikimedia') sizes FROM g GROUP BY source""")
def q_source_tables(spark: SparkSession, d: str) -> DataFrame:
    """Records of all sources in one JSON table by source: one source has a column of its own and lacks another, some lines are
    cut off; four of the sources are read."""
    path = shared.shared_path(spark)
    r = records(spark, d)
    wide, slim = r.select("record_id", "title", "asset"), r.select("record_id", "title", F.col("size").cast("int").alias("size"))
    line = F.when(F.col("source") == "wikimedia", F.to_json(F.struct("record_id", "title", F.col("size").cast("int").alias("size")))).otherwise(F.to_json(F.struct("record_id", "title", "asset")))
    whole = F.length(line) - F.when(F.col("size") % 11 == 0, 2).otherwise(0)
    files.write_sources(r.select(F.substr(line, F.lit(1), whole).alias("value"), "source"), path, "source", "text")
    good, bad = files.read_sources(spark, path, [wide.schema, slim.schema], "source", list(READ))
    counted = good.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("record_id").alias("ids"), F.count("asset").alias("assets"), F.sum("size").alias("sizes"))
    aside = bad.groupBy("source").agg(F.count(F.lit(1)).alias("corrupt"))
    out = counted.join(aside, "source", "full")
    corrupt = F.coalesce("corrupt", F.lit(0))
    return out.select("source", (F.coalesce("n", F.lit(0)) + corrupt).alias("n"), corrupt.alias("corrupt"), "ids", F.coalesce("assets", F.lit(0)).alias("assets"), "sizes")


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN concat('www.own', o_orderkey % 7, '.com') END own, count(l_orderkey) n,
  max(CAST(l_quantity AS DOUBLE)) best, min_by(concat('own', l_suppkey % 7, '.com'), (l_linenumber, concat('own', l_suppkey % 7, '.com'))) FILTER (l_linenumber % 3 <> 1) top FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT CAST(o_orderkey AS VARCHAR) brand_id, n results, best, coalesce(own, top) resolved_domain, CASE WHEN own IS NOT NULL THEN 'seed' WHEN top IS NOT NULL THEN 'search' ELSE 'missing' END domain_source,
CASE WHEN own IS NOT NULL AND top IS NOT NULL THEN replace(own, 'www.', '') = top END domain_matches_existing FROM r""")
def q_search_responses(spark: SparkSession, d: str) -> DataFrame:
    """Orders as search responses (their lines as results, some without a domain), written as JSON documents, read again and resolved."""
    path = shared.shared_path(spark)
    domain = F.when(F.col("l_linenumber") % 3 == 1, " ").otherwise(F.concat(F.lit("own"), F.col("l_suppkey") % 7, F.lit(".com")))
    one = F.struct("l_linenumber", domain.alias("domain"), F.col("l_quantity").cast("double").alias("_score"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(one)).alias("results"))  # the few lines of an order
    found = table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    files.write_json(found.select(F.col("o_orderkey").cast("string").alias("brand_id"), F.lit(200).alias("http_status"), F.coalesce("results", F.array().cast(lines.schema["results"].dataType)).alias("results")), path)
    read = files.read_search_responses(spark, path, lines=True)
    k = F.col("brand_id").cast("long")
    own = F.when(k % 4 == 0, F.concat(F.lit("www.own"), k % 7, F.lit(".com")))
    resolved = resolve.resolve_domain(read, own, F.col("results"))
    return resolved.select("brand_id", F.size("results").cast("long").alias("results"), F.array_max(F.transform("results", lambda r: r["_score"])).alias("best"), "resolved_domain", "domain_source", "domain_matches_existing")


@query("SELECT o_orderkey, o_custkey, o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'said \"no\",' || chr(10) || o_orderstatus END notes FROM orders")
def q_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as CSV with quotes and line breaks in a cell, and read again: blank cells are null."""
    path = shared.shared_path(spark)
    notes = F.when(F.col("o_orderkey") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(' said "no",\n'), "o_orderstatus"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", notes.alias("notes"), F.lit("x").alias("unused"))
    columns = ["o_orderkey", "o_custkey", "o_orderpriority", "notes"]
    files.write_csv(orders, path, columns)
    return files.read_csv(spark, path, orders.select(*columns).schema)


@query(r"""WITH f AS (SELECT regexp_extract(url, '^https?://([^?#]*)', 1) p, length(html) s FROM pages), q AS (SELECT list_filter(string_split_regex(p, '/+'), lambda x: x <> '') parts, s FROM f),
u AS (SELECT parts, s, unnest(range(0, len(parts))) depth FROM q)
SELECT array_to_string(parts[1:depth], '/') folder, CAST(depth AS INT) depth, count(*) FILTER (depth = len(parts) - 1) own_files, CAST(coalesce(sum(s) FILTER (depth = len(parts) - 1), 0) AS BIGINT) own_size, count(*) files, CAST(sum(s) AS BIGINT) size FROM u GROUP BY 1, 2""")
def q_folder_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files whose folders are those of their URLs, below their hosts."""
    pages = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^?#]*)", 1).alias("path"), F.length("html").cast("long").alias("size"))
    return files.folder_rollup(pages)


@query("""SELECT c.x column_name, c.x <> 'o_note' present, n, CASE c.x WHEN 'o_note' THEN n WHEN 'o_priority' THEN b ELSE 0 END blank
FROM (SELECT count(*) n, count(*) FILTER (o_orderkey % 5 = 0) b FROM orders), (SELECT unnest(['o_orderkey', 'o_priority', 'o_note']) x) c""")
def q_required_columns(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("o_priority", F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise(F.col("o_orderpriority")))
    return rules.column_report(orders, ("o_orderkey", "o_priority", "o_note"))
