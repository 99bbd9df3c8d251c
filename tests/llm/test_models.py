import collections
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogkit.llm import langid, line_dedup, near_dedup, packing, quality_model, quality_rules
from catalogkit.llm.common import id_remainder, table
from catalogkit.llm.queries import QUERIES, tokenizer_path

DATA = "/root/testdata/sf0.01"


def letters(alphabet, seed, n=300):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list(alphabet), rng.integers(2, 8))) for _ in range(n // 5))


def test_language_id_learns_and_defines_odd_rows(spark, make_docs, odd):
    texts = [letters("abcde", i) for i in range(20)] + [letters("vwxyz", i) for i in range(20)]
    model = langid.train(make_docs(texts, langs=["aa"] * 20 + ["zz"] * 20))
    fresh = make_docs([letters("abcde", 99), letters("vwxyz", 98), "123 !", *odd], ids=[None, 1, 2, *range(3, 3 + len(odd))])
    got = langid.predict(fresh, model, keep=(F.col("doc_id"), F.col("taken"))).orderBy("taken").collect()
    assert [r.lang_pred for r in got[:5]] == ["aa", "zz", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 3 + len(odd)
    assert got[7].lang_pred == got[9].lang_pred  # equal texts


def test_language_id_without_labels_or_rows(spark, make_docs):
    empty = make_docs([])
    model = langid.train(make_docs(["a"], langs=[None]))
    assert [tuple(r) for r in langid.predict(make_docs(["abc"]), model, keep=(F.col("doc_id"),)).collect()] == [(0, "und", 0.0)]
    assert langid.predict(empty, langid.train(empty), keep=(F.col("doc_id"),)).count() == 0


def test_ngrams_do_not_depend_on_slices(monkeypatch):
    text = letters("abcdefgh", 5, 4000)
    whole = np.sort(np.concatenate(list(langid.ngram_buckets(text, 12))))
    parts = np.sort(np.concatenate(list(quality_model.features(text, 12))))
    monkeypatch.setattr(langid, "SLICE", 97)
    monkeypatch.setattr(quality_model, "SLICE", 89)
    assert (np.sort(np.concatenate(list(langid.ngram_buckets(text, 12)))) == whole).all()
    assert (np.sort(np.concatenate(list(quality_model.features(text, 12)))) == parts).all()


def test_quality_model_separates_held_out_rows(spark, make_docs, odd):
    good, bad = [letters("abcdefgh", i) for i in range(40)], [letters("#$%&abc", i) for i in range(40)]
    labelled = make_docs(good[:30] + bad[:30]).withColumn("quality", F.when(F.col("doc_id") < 30, 1).otherwise(0))
    model = quality_model.train(labelled)
    got = quality_model.predict(make_docs(good[30:] + bad[30:] + odd), model, keep=(F.col("taken"),)).orderBy("taken").collect()
    assert all(r.score >= 0.5 for r in got[:10]) and all(r.score < 0.5 for r in got[10:20])
    assert got[20].score == got[21].score and all(0 <= r.score <= 1 for r in got)
    none = quality_model.train(labelled.where("false"))
    assert [r.score for r in quality_model.predict(make_docs(["x"]), none).collect()] == [0.5]


def brute_stats(text):
    text = text or ""
    words = text.encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    cover = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(cover)


def test_rule_statistics_against_brute_force(spark, make_docs, odd):
    texts = [*odd[:-1], "a b c a b c a b c d", "x\nx\n\n \nx", "# * a|b <c> &", "a b c d a b c", "é　x y z \x1f w"]
    got = quality_rules.with_stats(make_docs(texts), keep=(F.col("taken"),)).orderBy("taken").collect()
    for t, r in zip(texts, got):
        assert tuple(r[c] for c in quality_rules.COUNTS) == brute_stats(t), t


def test_isolation_forest_rejects_junk_and_keeps_the_rest(spark, make_docs):
    good = [letters("abcdefgh", i, 600) for i in range(150)]
    junk = [" ".join(f"{w}###" for w in letters("abcdefgh", i, 600).split()) for i in range(15)]
    docs = make_docs(good + junk + [None, "few words"])
    labels = docs.where("doc_id < 165").select("doc_id", (F.col("doc_id") < 150).cast("int").alias("quality"))
    stats = quality_rules.with_stats(docs, keep=(F.col("doc_id"),))
    got = {r.doc_id: r for r in quality_rules.judge(stats, quality_rules.train(stats, labels)).collect()}
    assert sum(got[i].kept for i in range(150)) >= 149 and not any(got[i].kept for i in range(150, 165))
    assert got[165].base_failed and got[166].base_failed and not got[0].base_failed
    calm = quality_rules.judge(stats, quality_rules.train(stats, labels.where("quality = 1")))
    assert calm.where("kept").count() == 165
    assert quality_rules.judge(stats.where("false"), quality_rules.train(stats.where("false"), labels)).count() == 0


def test_forest_sees_statistics_within_the_usual_range_and_all_labels(spark):
    rng = np.random.default_rng(3)
    shares = [float(rng.choice([0.1, 0.5]) + rng.uniform(-0.02, 0.02)) for _ in range(600)]
    rows = [(i, 100, 500, 0, 0, 0, s, 0.1, 0.0, 0.1, 3) for i, s in enumerate(shares)]
    rows += [(600 + i, 100, 500, 90, 0, 0, 0.1, 0.1, 0.0, 0.1, 3) for i in range(20)]
    rows += [(700, 100, 500, 0, 0, 0, 0.3, 0.1, 0.0, 0.1, 3), (701, 100, 500, 0, 0, 0, 0.1, 0.1, 0.0, 0.1, 3)]
    stats = spark.createDataFrame(rows, "doc_id long, " + quality_rules.STATS)
    labels = stats.where("doc_id < 700").select("doc_id", (F.col("doc_id") < 600).cast("int").alias("quality"))
    model = quality_rules.train(stats, labels)
    got = {r.doc_id: r for r in quality_rules.judge(stats, model).collect()}
    assert got[700].anomaly > got[701].anomaly  # in a gap of the range, and a usual one
    few = quality_rules.train(stats, labels, max_rows=100)
    assert (few[0][-1] == model[0][-1]).all()
    kept = [r.kept for r in quality_rules.judge(stats, few).orderBy("doc_id").collect()]
    assert sum(kept[:600]) >= 599 and not any(kept[600:620])
    assert got[701].kept


def gram_hash(gram, bits):
    """The bucket of one n-gram in plain integers: one of n characters takes n mixing steps."""
    h, mask = 0, (1 << 64) - 1
    for n, c in enumerate(gram, 1):
        h = (h + ord(c) + n) * 0x9E3779B97F4A7C15 & mask
        h ^= h >> 29
    return (h * 0x9E3779B97F4A7C15 & mask) >> (64 - bits)


def grams(text, bits):
    low = text.lower()
    return [gram_hash(low[i : i + n], bits) for n in langid.ORDERS for i in range(len(low) - n + 1)]


def test_language_id_equals_naive_bayes_with_dictionaries(spark, make_docs):
    bits, texts, langs = 10, ["abba CAB", "bad cab!", "zyx wyz", "xyzzy é"], ["aa", "aa", "zz", "zz"]
    counts = {y: collections.Counter(g for t, own in zip(texts, langs) if own == y for g in grams(t, bits)) for y in set(langs)}
    model = langid.train(make_docs([*texts, "no label"], langs=[*langs, None]), bits=bits)
    fresh = ["abz yx", "Cab", "wyz é wyz", "bzbzbz", "b", "xa" * 300]
    got = langid.predict(make_docs(fresh), model, keep=(F.col("doc_id"),)).orderBy("doc_id").collect()
    for t, r in zip(fresh, got):
        logs = {y: math.log(0.5) + sum(math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * 2**bits)) for g in grams(t, bits)) for y, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        assert r.lang_pred == best
        assert abs(r.score - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-3


def test_batches_hold_the_entries_of_each_text(monkeypatch):
    texts = [letters("abcdefgh", i, 60 * i) for i in range(5)] + ["", "İ", "ab", letters("xyz", 9, 900)]
    for size in (1 << 18, 97, 7):
        monkeypatch.setattr(langid, "SLICE", size)
        found = collections.Counter(pair for at, ids in langid.batch_buckets(texts, 12) for pair in zip(at.tolist(), ids.tolist()))
        assert found == collections.Counter((i, g) for i, t in enumerate(texts) for g in grams(t, 12))


def test_rare_languages_stay_in_the_sample(spark, make_docs):
    texts = [letters("abcde", i) for i in range(200)] + [letters("vwxyz", i) for i in range(2)]
    labels, matrix = langid.train(make_docs(texts, langs=["aa"] * 200 + ["zz"] * 2), max_rows=20)
    assert labels == ["aa", "zz"] and np.allclose(np.exp(matrix[-1]), [200 / 202, 2 / 202])
    got = langid.predict(make_docs([letters("vwxyz", 50)]), (labels, matrix)).collect()
    assert got[0].lang_pred == "zz"
    assert langid.quota([5, 3, 100, 100], 50) == 21 and langid.quota([5, 3], 50) == 5 and langid.quota([9] * 30, 20) == 1 and langid.quota([], 5) == 1
    with pytest.raises(ValueError):
        langid.train(make_docs(["a", "b"], langs=["x", "y"]), max_labels=1)


def test_descent_equals_plain_loops():
    bits, dim, epochs, rate, seed = 6, 3, 2, 0.5, 4
    texts, y = ["good words here", "bad bad bad", "", "fine prose", "## ##"], np.array([1, 0, 1, 1, 0])
    bags = [quality_model._bag(t, bits) for t in texts]
    model = quality_model.fit(bags, y, bits, dim, epochs, rate, seed)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).tolist()
    out, bias, done = [[0.0, 0.0] for _ in range(dim)], [0.0, 0.0], 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            own = list(zip(bags[i][0].tolist(), bags[i][1].tolist()))
            hidden = [sum(w * vectors[b][d] for b, w in own) for d in range(dim)]
            e = [math.exp(bias[c] + sum(hidden[d] * out[d][c] for d in range(dim))) for c in (0, 1)]
            off = [v / sum(e) - (c == y[i]) for c, v in enumerate(e)]
            step = rate * (1 - done / (epochs * len(y)))
            back = [sum(out[d][c] * off[c] for c in (0, 1)) for d in range(dim)]
            for c in (0, 1):
                bias[c] -= step * 0.1 * off[c]
                for d in range(dim):
                    out[d][c] -= step * hidden[d] * off[c]
            for b, w in own:
                for d in range(dim):
                    vectors[b][d] -= step * w * back[d]
            done += 1
    folded = [sum(v[d] * (out[d][1] - out[d][0]) for d in range(dim)) for v in vectors]
    assert np.allclose(model, [*folded, bias[1] - bias[0]], atol=1e-5)


def test_quality_score_equals_the_average_of_vectors(spark, make_docs):
    bits, texts = 8, ["one two one", "", "é x x", "a b c " * 50]
    model = np.random.default_rng(1).normal(size=(1 << bits) + 1).astype(np.float32)
    got = quality_model.predict(make_docs(texts), model, keep=(F.col("doc_id"),)).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        ids, share = quality_model._bag(t, bits)
        logit = float(model[-1]) + sum(float(model[b]) * float(w) for b, w in zip(ids, share))
        assert abs(r.score - 1 / (1 + math.exp(-logit))) < 1e-5


def test_isolation_equals_plain_descent():
    x = np.random.default_rng(2).normal(size=(80, 3))
    x[:5] += 6
    feature, split, path, size = grown = quality_rules.grow(x, 7, 64, 1)
    got = quality_rules.isolation(x, grown)
    for row, score in zip(x, got):
        total = 0.0
        for f, s, p in zip(feature, split, path):
            node = 0
            while f[node] >= 0:
                node = 2 * node + (2 if row[f[node]] > s[node] else 1)
            total += p[node]
        assert abs(score - 2 ** (-total / 7 / quality_rules.average_path(size))) < 1e-12
    assert got[:5].min() > np.median(got[5:])


def test_models_of_nothing_and_labels_without_documents(spark, make_docs):
    docs, none = make_docs(["some words", None]), make_docs([])
    strangers = spark.createDataFrame([(99, 1), (98, 0), (None, 1)], "doc_id long, quality int")
    model = quality_model.train(docs.join(strangers, "doc_id"))
    assert [r.score for r in quality_model.predict(docs, model).collect()] == [0.5, 0.5]
    assert quality_model.predict(none, model).count() == 0
    stats = quality_rules.with_stats(docs, keep=(F.col("doc_id"),))
    forest, limit = quality_rules.train(stats, strangers)
    assert forest == () and limit == np.inf
    assert [r.kept for r in quality_rules.judge(stats, (forest, limit)).collect()] == [False, False]


def test_results_replace_columns_of_the_same_name(spark, make_docs):
    docs = make_docs(["some words", None]).selectExpr("doc_id", "text", "'x' score", "'x' lang_pred", "'x' n_words", "'x' anomaly", "'x' kept", "'x' base_failed")
    everything = tuple(F.col(c) for c in docs.columns)
    got = langid.predict(docs, langid.train(make_docs(["a"])), keep=everything)
    assert got.columns == ["doc_id", "text", "n_words", "anomaly", "kept", "base_failed", "lang_pred", "score"] and {r.lang_pred for r in got.collect()} == {"en", "und"}
    got = quality_model.predict(docs, np.zeros(9, np.float32), keep=everything)
    assert got.columns[-1] == "score" and got.columns.count("score") == 1 and {r.score for r in got.collect()} == {0.5}
    got = quality_rules.judge(quality_rules.with_stats(docs, keep=everything), ((), np.inf))
    assert len(set(got.columns)) == len(got.columns) and [r.n_words for r in got.orderBy("doc_id").collect()] == [2, 0]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_held_out_figures(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels").where("quality is not null").select("doc_id", "quality")
    named = QUERIES["op1_language_id"](spark, DATA).join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(named) > 200 and (named.lang == named.lang_pred).mean() >= 0.99
    scored = QUERIES["op6_quality_classifier"](spark, DATA).join(labels, "doc_id").where("held_out").toPandas()
    rank, good = scored.score.rank(), scored.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc >= 0.98 and ((scored.score >= 0.5) == good).mean() >= 0.97
    stats = quality_rules.with_stats(docs, keep=(F.col("doc_id"),))
    model = quality_rules.train(stats, labels.where(id_remainder(F.col("doc_id"), 3) != 1))
    judged = quality_rules.judge(stats, model).join(labels.where(id_remainder(F.col("doc_id"), 3) == 1), "doc_id").toPandas()
    judged = judged[~judged.base_failed]
    good = judged.quality == 1
    assert judged[good].kept.mean() >= 0.97 and (~judged[~good].kept).mean() >= 0.9


def test_large_identifiers_stay_exact_beside_nulls(spark, make_docs, prose):
    """Whole numbers with nulls would be floats in pandas, which lose digits."""
    big = (1 << 62) + 1
    texts = [prose(i, 60) for i in range(6)]
    docs = make_docs(texts, ids=[None, big, big + 2, None, big + 4, 7], langs=["en", "de", "en", None, "de", "en"]).coalesce(1)
    want = [None, None, 7, big, big + 2, big + 4]
    ids = lambda df, c="doc_id": sorted((r[c] for r in df.collect()), key=lambda x: (x is not None, x))
    key = (F.col("doc_id"),)
    assert ids(langid.predict(docs, langid.train(docs), keep=key)) == want
    assert ids(quality_rules.with_stats(docs, keep=key)) == want
    assert ids(quality_model.predict(docs, np.zeros(1025, np.float32), keep=key)) == want
    assert ids(line_dedup.deduplicate(docs)) == want and ids(line_dedup.deduplicate(docs, max_sent=-1)) == want
    assert ids(near_dedup.groups(docs), "id") == want
    assert ids(packing.pack(packing.pieces(docs, tokenizer_path(), keep=key))) == want
    assert ids(near_dedup.with_digest(docs, "x")) == want


def plain_threshold(scores, total, max_false, gone):
    """``scores``: (score, label) pairs; the step that rejects the largest share of bad rows less that of good ones."""
    best, limit = 0.0, math.inf
    for step in sorted({math.floor(s * quality_rules.STEPS) for s, _ in scores}, reverse=True):
        caught = [y for s, y in scores if math.floor(s * quality_rules.STEPS) >= step]
        if caught.count(1) + gone <= max_false * total[1]:
            gain = caught.count(0) / total[0] - caught.count(1) / total[1]
            if gain > best:
                best, limit = gain, step / quality_rules.STEPS
    return limit


@pytest.mark.parametrize("max_false", [0.002, 0.05])
def test_quality_thresholds_equal_plain_counts(spark, max_false):
    stats = quality_rules.with_stats(table(spark, DATA, "documents"), keep=(F.col("doc_id"),)).cache()
    labels = table(spark, DATA, "labels")
    (outer, inner, _, limits), limit = quality_rules.train(stats, labels, max_false=max_false)
    rows = stats.where(~quality_rules.base_failed()).join(labels.where("quality in (0, 1)").select("doc_id", "quality"), "doc_id").toPandas()
    x, y = quality_rules._matrix(rows), rows["quality"].tolist()
    total = {v: y.count(v) for v in (0, 1)}
    good = np.sort(x[rows["quality"].to_numpy() == 1], axis=0)
    # the quantiles as ranks: the smallest value that so large a share of rows does not exceed
    low, high = (good[max(0, math.ceil(q * len(good)) - 1)] for q in (max_false / 4, 1 - max_false / 4))
    assert np.allclose(limits, [low - 0.1 * (high - low), high + 0.1 * (high - low)])
    first = list(zip(quality_rules.isolation(quality_rules.excess(x, limits), outer).tolist(), y))
    want = plain_threshold(first, total, max_false, 0)
    kept = [s < want for s, _ in first]
    gone = sum(v == 1 and math.floor(s * quality_rules.STEPS) >= want * quality_rules.STEPS for s, v in first) if want < math.inf else 0
    second = [(s, v) for s, v, k in zip(quality_rules.isolation(x, inner).tolist(), y, kept) if k]
    further = plain_threshold(second, total, max_false, gone)
    if further == math.inf:
        further = (max(math.floor(s * quality_rules.STEPS) for s, v in second if v == 1) + 1) / quality_rules.STEPS
    assert limit == pytest.approx(further if want == math.inf else want)
    if want < math.inf:
        model = quality_rules.train(stats, labels, max_false=max_false)
        assert model[0][2][1] == pytest.approx(want - further)
    stats.unpersist()
