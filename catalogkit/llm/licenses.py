"""License scan by diagonal voting, with DataFrame functions only.

The hashes of all rolling word pairs of a document are held against those of a small, fixed
set of template phrases; what is among them meets the pairs in a broadcast join (the words
themselves are compared on a hit), so that no row holds more than its own pair. Each hit votes for the diagonal document position - template position.
Votes are summed by diagonal, neighbouring diagonals are merged (words added or left
out), and a merged span counts if enough of its template is there in a span of about
its length: either a chain of diagonals with a quarter of the pairs each, or any run of
diagonals at most twice ``shift`` apart, however few votes each of them has. A diagonal with a vote from each pair of a phrase is an exact place.

Defined results: a null text is empty, with no words, labels '' and score 0. Equal
rows (identifier and text) are counted once and returned as often as they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalogkit.llm.common import ascii_lower

#: Label, whether it is a base phrase, phrase.
TEMPLATES = (
    ("cc-by", True, "cc by"),
    ("gpl", True, "general public license"),
    ("reserved", True, "all rights reserved"),
    ("apache-2.0", False, "licensed under the apache license version 2 0"),
    ("cc-by-nc", False, "licensed under cc by nc 4 0"),
    ("gpl-3.0", False, "licensed under the gnu general public license version 3"),
    ("mit", False, "released under the mit license"),
    ("mit", False, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", False, "redistribution and use in source and binary forms with or without modification are permitted"),
)
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def scan_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), lambda w: w != "")


def _pairs(ws: Column) -> Column:
    return F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1)))


def template_pairs(spark: SparkSession, templates: tuple = TEMPLATES) -> DataFrame:
    """One row for each word pair of each template: a table of fixed size."""
    made = F.array(*(F.struct(F.lit(i).alias("tid"), F.lit(a).alias("label"), F.lit(b).alias("base"), F.array(*map(F.lit, p.split())).alias("ws")) for i, (a, b, p) in enumerate(templates)))
    t = spark.range(1).select(F.inline(made))
    pairs = t.select("tid", "label", "base", "ws", F.size("ws").alias("m"), F.posexplode(_pairs(F.col("ws"))).alias("tpos", "th"))
    return pairs.where("tpos < m - 1").select("*", F.get("ws", F.col("tpos")).alias("tw1"), F.get("ws", F.col("tpos") + 1).alias("tw2")).drop("ws")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple = TEMPLATES, coverage: float = 0.75, shift: int = 2) -> DataFrame:
    """One row for each document: its words, the exact places of base phrases and the
    labels. ``coverage``: the share of a template's pairs that a merged span must
    have; ``shift``: how far apart neighbouring diagonals may lie."""
    known = template_pairs(docs.sparkSession, templates)
    hashes = [r.th for r in known.select("th").distinct().collect()]  # as many as the templates have pairs
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), scan_words(F.col(text)).alias("ws"))
    ws = F.col("ws")
    pairs = F.transform(ws, lambda w, i: F.struct(i.alias("p"), F.xxhash64(w, F.get(ws, i + 1)).alias("h"), w.alias("w1"), F.get(ws, i + 1).alias("w2")))
    # the document's own row has no hash and stays without a template
    own = F.array(F.struct(*(F.lit(None).cast(t).alias(c) for c, t in (("p", "int"), ("h", "long"), ("w1", "string"), ("w2", "string")))))
    grams = rows.select("doc_id", "key", F.size("ws").alias("size"), F.inline(F.concat(own, F.filter(pairs, lambda x: x["h"].isin(hashes)))))
    hit = (F.col("h") == F.col("th")) & (F.col("w1") == F.col("tw1")) & (F.col("w2") == F.col("tw2"))
    hits = grams.join(F.broadcast(known), hit, "left").where("p is null or tid is not null")
    votes = hits.select("doc_id", "key", F.when(F.col("p").isNull(), F.col("size")).alias("n_words"), "tid", "label", "base", "m", "tpos", (F.col("p") - F.col("tpos")).alias("diagonal"))

    lines = votes.groupBy("doc_id", "key", "tid", "label", "base", "m", "diagonal").agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"), F.collect_set("tpos").alias("seen"))
    run = W.partitionBy("doc_id", "key", "tid").orderBy("diagonal").rangeBetween(0, 2 * shift)
    lines = lines.withColumn("near", F.size(F.array_distinct(F.flatten(F.collect_list("seen").over(run)))) / (F.col("m") - 1))
    core = F.coalesce(4 * F.size("seen") >= F.col("m") - 1, F.lit(True))
    lines = lines.withColumn("core", core).where(F.col("core") | (~F.col("base") & (F.col("near") >= coverage)))
    of = W.partitionBy("doc_id", "key", "tid", "core").orderBy("diagonal")
    merged = lines.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(of) > shift).cast("int"))
    merged = merged.withColumn("span", F.sum(F.coalesce("new", F.lit(1))).over(of))
    spans = merged.groupBy("doc_id", "key", "tid", "core", "span").agg(
        F.max("n_words").alias("n_words"), F.sum("copies").alias("copies"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("m").alias("m"),
        F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("seen"),
        F.max("near").alias("near"), F.min(F.col("diagonal") + F.array_min("seen")).alias("start"), F.max(F.col("diagonal") + F.array_max("seen") + 2).alias("end"),
        F.count_if(F.col("base") & (F.size("seen") == F.col("m") - 1)).alias("places"),
        F.min(F.when(F.col("base") & (F.size("seen") == F.col("m") - 1), F.col("diagonal"))).alias("first"),
        F.max(F.when(F.col("base") & (F.size("seen") == F.col("m") - 1), F.col("diagonal"))).alias("last"),
    )
    chain = F.col("seen") / (F.col("m") - 1)
    fits = F.col("core") & (chain >= coverage) & (F.col("end") - F.col("start") <= F.col("m") + 2 * shift)
    share = F.greatest(F.when(fits, chain), F.col("near"))
    verified = ~F.col("base") & (share >= coverage)
    is_base = F.col("places") > 0
    found = spans.groupBy("doc_id", "key").agg(
        F.max("n_words").cast("long").alias("n_words"), F.sum("copies").alias("copies"), F.sum("places").alias("n_base"),
        F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base | verified, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(is_base, 1.0).when(verified, share)), F.lit(0.0)).alias("score"),
    )
    return found.select(F.explode(F.array_repeat("doc_id", F.col("copies").cast("int"))).alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def oracle(templates: tuple = TEMPLATES, coverage: float = 0.75, shift: int = 2) -> str:
    """The same scan as DuckDB SQL, with word pairs compared directly."""
    listed = ", ".join(f"({i}, '{a}', {str(b).lower()}, string_split('{p}', ' '))" for i, (a, b, p) in enumerate(templates))
    return rf"""
    WITH t(tid, label, base, ws) AS (VALUES {listed}),
    tp AS (SELECT tid, label, base, ws, len(ws) m, unnest(range(0, len(ws) - 1)) tpos FROM t),
    tg AS (SELECT tid, label, base, m, tpos, ws[tpos + 1] a, ws[tpos + 2] b FROM tp),
    d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BREAK}'), lambda x: x <> '') w FROM documents),
    p AS (SELECT doc_id, unnest(range(0, len(w) - 1)) pos, w FROM d),
    g AS (SELECT doc_id, pos, w[pos + 1] a, w[pos + 2] b FROM p),
    l0 AS (SELECT doc_id, tid, label, base, m, pos - tpos diagonal, count(DISTINCT tpos) votes, list(DISTINCT tpos) seen, min(pos) lo, max(pos) + 2 hi FROM g JOIN tg USING (a, b) GROUP BY ALL),
    l1 AS (SELECT *, 4 * votes >= m - 1 core, len(list_distinct(flatten(list(seen) OVER (PARTITION BY doc_id, tid ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {2 * shift} FOLLOWING)))) / (m - 1) near FROM l0),
    l AS (SELECT * FROM l1 WHERE core OR (NOT base AND near >= {coverage})),
    n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, tid, core ORDER BY diagonal) <= {shift} THEN 0 ELSE 1 END fresh FROM l),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, tid, core ORDER BY diagonal) span FROM n),
    c AS (SELECT doc_id, tid, core, span, any_value(label) label, any_value(base) base, any_value(m) m, len(list_distinct(flatten(list(seen)))) / (any_value(m) - 1) chain, max(near) near,
                 min(lo) s0, max(hi) s1, count(*) FILTER (base AND votes = m - 1) places,
                 min(diagonal) FILTER (base AND votes = m - 1) f, max(diagonal) FILTER (base AND votes = m - 1) z FROM s GROUP BY doc_id, tid, core, span),
    v AS (SELECT *, CASE WHEN core AND chain >= {coverage} AND s1 - s0 <= m + {2 * shift} AND chain > near THEN chain ELSE near END share FROM c),
    r AS (SELECT doc_id, sum(places) n_base, min(f) first_word, max(z) last_word, max(CASE WHEN places > 0 THEN 1.0 WHEN NOT base AND share >= {coverage} THEN share END) score,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0) base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0 OR (NOT base AND share >= {coverage})) labels FROM v GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_base, 0) AS BIGINT) n_base, CAST(first_word AS BIGINT) first_word, CAST(last_word AS BIGINT) last_word,
           coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, CAST(coalesce(score, 0) AS DOUBLE) score
    FROM d LEFT JOIN r ON d.doc_id = r.doc_id"""
