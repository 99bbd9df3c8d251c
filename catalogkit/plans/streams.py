"""Queries that run as streams over several arrivals, stopped and started again between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogkit.plans.registry import query, table
from catalogkit.sources import shared
from catalogkit.streaming import answers, state

PARTS = 4


@query("SELECT user_id, max_by(event_type, (ts, event_id)) event_type, max(ts) ts FROM events GROUP BY user_id")
def q_upsert_stream(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of each user, kept by micro-batches that come in no order of time."""
    path = shared.shared_path(spark)
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    merge = state.upsert_latest_into(f"{path}/latest", "user_id", "ts")
    for stream in state.arrivals(e, (F.col("event_id") % PARTS).cast("int"), PARTS, path):
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return state.read_latest(spark, f"{path}/latest").select("user_id", "event_type", "ts")


# requests in order of time, in four arrivals; a seventh of the attempts succeed; a request is due again after two hours
REQUESTS = r"""r AS (SELECT user_id, event_id, ts, CAST(regexp_extract(props, '"k": ?(\d+)', 1) AS INT) % 7 = 0 ok FROM events),
f AS (SELECT user_id, min((ts, event_id)) won FROM r WHERE ok GROUP BY user_id),
t AS (SELECT r.*, row_number() OVER (PARTITION BY r.user_id ORDER BY ts, event_id) attempt, lead(ts) OVER (PARTITION BY r.user_id ORDER BY ts, event_id) later FROM r LEFT JOIN f ON r.user_id = f.user_id WHERE won IS NULL OR (ts, event_id) <= won)"""


@query(rf"""WITH {REQUESTS}, m AS (SELECT max(ts) - INTERVAL 1 HOUR wm FROM events)
SELECT user_id, event_id, epoch_us(ts) // 1000 at_ms, attempt, CASE WHEN attempt = 1 THEN 'first' ELSE 'again' END "action" FROM t UNION ALL
SELECT user_id, NULL, epoch_us(ts) // 1000 + 7200000, attempt, 'due' FROM t, m WHERE NOT ok AND epoch_us(ts) // 1000 + 7200000 <= epoch_us(coalesce(later, wm)) // 1000""")
def q_collect_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests of a collector that is stopped after each arrival and resumed."""
    path = shared.shared_path(spark)
    e = table(spark, d, "events")
    r = e.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.get_json_object("props", "$.k").cast("int") % 7 == 0).alias("ok"))
    low, high = r.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    part = F.floor((F.unix_micros("ts") - F.lit(low)) * PARTS / F.lit(max(high - low, 1) + 1)).cast("int")
    for stream in state.arrivals(r, part, PARTS, path):
        found = state.append_to(state.collect_with_retries(stream, "user_id", "event_id", "ts", "ok", 7_200), f"{path}/found", f"{path}/checkpoint")
    return found.select("user_id", "event_id", F.unix_millis("at").alias("at_ms"), "attempt", "action")


# answers come up to an hour late, every fiftieth with the last arrival; a session ends after six hours; the watermark is two hours behind
LATE = r"""
v AS (SELECT *, coalesce(c.grp, 'other') grp FROM (SELECT event_id, user_id, ts, CAST(regexp_extract(props, '"k": ?(\d+)', 1) AS INT) k, epoch_us(ts) us FROM events) LEFT JOIN (SELECT p_partkey, p_brand grp FROM part) c ON c.p_partkey = k),
b AS (SELECT min(us) low, max(us) - min(us) + 1 span FROM v),
p AS (SELECT v.*, CASE WHEN event_id % 50 = 0 THEN 3 ELSE CAST(least(3, floor((us + event_id % 60 * 60000000 - low) * 4 / span)) AS INT) END part FROM v, b),
w AS (SELECT max(us) FILTER (part < 3) // 1000 * 1000 - 7200000000 before, max(us) // 1000 * 1000 - 7200000000 finally FROM p),
x AS (SELECT p.*, before, finally FROM p, w WHERE part < 3 OR us + 21600000000 > before)"""


def islands(rows: str, name: str) -> str:
    """SQL of the gap sessions of rows: each row with the start and end of its session."""
    return f"""{name}0 AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) <= 21600000000 THEN 0 ELSE 1 END new FROM {rows}),
{name}1 AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) island FROM {name}0),
{name} AS (SELECT *, max(us) OVER (PARTITION BY user_id, island) + 21600000000 ended FROM {name}1)"""


@query(f"""WITH {LATE}, {islands("(SELECT * FROM x WHERE part < 3 OR event_id % 50 <> 0)", "i")},
c AS (SELECT * EXCLUDE (new, island, ended) FROM i WHERE ended <= before), o AS (SELECT * EXCLUDE (new, island, ended) FROM i WHERE ended > before UNION ALL SELECT * FROM x WHERE part = 3 AND event_id % 50 = 0),
{islands("c", "d")}, {islands("o", "e")}, a AS (SELECT * FROM d UNION ALL SELECT * FROM e)
SELECT user_id, min(us) // 1000 started_ms, ended // 1000 ended_ms, count(*) total, count(*) FILTER (k % 2 = 0) score, string_agg(DISTINCT grp, ',' ORDER BY grp) categories FROM (SELECT *, 1 closed FROM d UNION ALL SELECT *, 0 FROM e) WHERE ended <= finally GROUP BY user_id, closed, island, ended""")
def q_stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of answers that come late, each with the categories of a static table."""
    path = shared.shared_path(spark)
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    low, high = e.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    came = F.unix_micros("ts") + F.col("event_id") % 60 * 60_000_000 - F.lit(low)
    part = F.when(F.col("event_id") % 50 == 0, PARTS - 1).otherwise(F.least(F.floor(came * PARTS / F.lit(max(high - low, 0) + 1)), F.lit(PARTS - 1))).cast("int")
    named = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("grp"))
    for stream in state.arrivals(e, part, PARTS, path):
        joined = answers.with_category(stream.withColumn("right", F.col("k") % 2 == 0), named, "k", "grp", "other")
        found = state.append_to(answers.sessions(joined, "user_id", "ts", "right", "6 hours", "2 hours", "grp"), f"{path}/found", f"{path}/checkpoint")
    return found.select("user_id", F.unix_millis("started").alias("started_ms"), F.unix_millis("ended").alias("ended_ms"), "total", "score", F.array_join("categories", ",").alias("categories"))
