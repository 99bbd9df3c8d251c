"""The registered queries over the driver's tables: one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogkit.llm import collocations, exact_dedup, fim, langid, licenses, line_dedup, mixing, near_dedup, packing, quality_model, quality_rules, substring_dedup, token_files
from catalogkit.llm.common import id_remainder, shared_dir, stored, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs, model, keep=(F.col("doc_id"), held_out.alias("held_out"))).select("doc_id", "held_out", "lang_pred", "score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.groups(table(spark, sf_dir, "documents"), n=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), "quality").where("quality is not null")
    labelled = docs.where(~held_out).select("doc_id", "text").join(labels, F.col("doc_id") == F.col("k"))
    scored = quality_model.predict(docs, quality_model.train(labelled), keep=(F.col("doc_id"), held_out.alias("held_out")))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(quality_rules.with_stats(table(spark, sf_dir, "documents"), keep=(F.col("doc_id"),)))  # texts are measured once
    return quality_rules.judge(stats, quality_rules.train(stats, table(spark, sf_dir, "labels"))).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "anomaly")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path(), keep=(F.col("doc_id"),))
    return packing.pack(made).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"), with_text=False)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = stored(mixing.measured(table(spark, sf_dir, "documents")).select("doc_id", "source", "__size", "__v"))
    mixed = mixing.apply_limits(slim, mixing.limits(slim))
    return mixed.select("doc_id", *(F.col(f"__{c}").alias(c) for c in ("size", "source_size", "target", "taken")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("fim_text")).alias("output_sha256"), digest(fim.restored(F.col("fim_text"), F.col("form"))).alias("restored_sha256"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return token_files.with_crc32(token_files.read(spark, path))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_quality_rules": op7_quality_rules,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_source_mixing": op10_source_mixing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_token_files": op12_token_files,
    "op13_collocations": op13_collocations,
}
EXACT_DEDUP = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) keep_id, count(*) OVER (PARTITION BY t) group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) kept, sha256(t) text_sha256 FROM d"""
SPLIT = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, {SPLIT.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) ELSE w END sh FROM d),
e AS (SELECT doc_id, len(sh) n, unnest(sh) x FROM s),
p AS (SELECT a.doc_id a, b.doc_id b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) n_shingles, min(other) component_id, s.doc_id = min(other) kept FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id, len(sh)"""
SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {SPLIT.format("coalesce(text, '')")} w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) i FROM d),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') k FROM s),
f AS (SELECT k, min(doc_id) m FROM g GROUP BY k),
r AS (SELECT DISTINCT g.doc_id, g.i + o j FROM g JOIN f ON g.k = f.k AND f.m < g.doc_id, (SELECT unnest(range(0, 13)) o)),
x AS (SELECT doc_id, unnest(w) word, generate_subscripts(w, 1) j FROM d),
t AS (SELECT x.doc_id, count(r.j) n, string_agg(word, ' ' ORDER BY x.j) FILTER (r.j IS NULL) kept FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND x.j = r.j GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n, 0) AS BIGINT) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN t ON d.doc_id = t.doc_id"""
ORACLES: dict[str, str] = {"op2_license_scan": licenses.oracle(), "op3_exact_dedup": EXACT_DEDUP, "op4_line_dedup": line_dedup.oracle(), "op5_minhash_near_dedup": NEAR_DEDUP, "op9_substring_dedup": SUBSTRINGS, "op10_source_mixing": mixing.ORACLE, "op11_fill_in_middle": fim.ORACLE, "op13_collocations": collocations.ORACLE}
