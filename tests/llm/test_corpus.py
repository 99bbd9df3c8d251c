import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogkit.llm import licenses, mixing, packing
from catalogkit.llm.common import stored
from catalogkit.llm.queries import ORACLES, QUERIES, tokenizer_path


def brute_licenses(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for label, base, p in licenses.TEMPLATES if base for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(spark, make_docs, odd):
    texts = [
        *odd[:-1], "CC BY cc-by CC  by", "All rights reserved. all RIGHTS, reserved!", "general public license", "GENERAL\nPUBLIC-LICENSE cc by",
        "Licensed under the Apache License, Version 2.0.", "Licensed under the new Apache License, Version 2.0", "cc", "K cc by", "all all rights rights reserved reserved",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ]
    got = {r.doc_id: r for r in licenses.scan(make_docs(texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert [got[i].labels for i in (12, 13, 17)] == ["apache-2.0", "apache-2.0", "mit"]


def test_license_scan_repeats_nulls_and_nothing(spark, make_docs):
    got = licenses.scan(make_docs(["cc by", "cc by", "cc by x", None], ids=[None, None, 3, 3])).collect()
    assert sorted((r.doc_id is None, r.n_words, r.n_base) for r in got) == [(False, 0, 0), (False, 3, 1), (True, 2, 1), (True, 2, 1)]
    assert licenses.scan(make_docs([])).count() == 0


def test_license_scan_adds_up_votes_of_thin_diagonals(spark, make_docs):
    phrase = "permission is hereby granted free of charge to any person obtaining a copy of this software".split()
    split = [*phrase[:9], "x", *phrase[9:13], "y", *phrase[13:]]
    apart = [*phrase[:4], "x", *phrase[4:8], "y", *phrase[8:12], "z", *phrase[12:]]
    got = {r.doc_id: r for r in licenses.scan(make_docs([" ".join(split), " ".join(apart), " ".join(phrase[::-1])])).collect()}
    assert [got[i].labels for i in range(3)] == ["mit", "mit", ""]
    assert abs(got[0].score - 13 / 15) < 1e-9 and abs(got[1].score - 12 / 15) < 1e-9


def test_license_scan_equals_its_sql_on_thin_diagonals(spark, make_docs):
    duckdb = pytest.importorskip("duckdb")
    rng, texts = random.Random(4), []
    for _, _, phrase in licenses.TEMPLATES:
        words = phrase.split()
        for holes in (0, 1, 2, 3, 4, 6):
            made = list(words)
            for _ in range(holes):
                made[rng.randrange(len(made)) : 0] = ["x"] * rng.randrange(1, 3)
            texts.append(" ".join(["and", *made, *made[: rng.randrange(4)]]))
            texts.append(" ".join(w for w in made if rng.random() > 0.1 * holes))
    got = licenses.scan(make_docs(texts))
    con = duckdb.connect()
    con.register("documents", make_docs(texts).select("doc_id", "text").toPandas())
    want = con.execute(licenses.oracle()).fetchall()
    key = lambda r: (r[0], r[1], r[2], r[3], r[4], r[5], r[6], round(r[7], 9))
    assert sorted(key(tuple(r)) for r in got.collect()) == sorted(map(key, want))
    assert len({r[6] for r in want}) > 5


def test_license_scan_of_a_very_long_text(spark, make_docs, prose):
    text = " ".join([prose(1, 100_000), "all rights reserved", prose(2, 99_990), "cc by"])
    (r,) = licenses.scan(make_docs([text])).collect()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels) == (199_995, 2, 100_000, 199_993, "cc-by,reserved")


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, capped = {s: weights[i % 3] for i, s in enumerate(names)}, sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(cap * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return {s: share.get(s, cap * sizes[s]) for s in names}
        capped |= over


def test_mixing_targets_and_whole_epochs(spark, make_docs, prose, monkeypatch):
    sources = ["b"] * 30 + ["a"] * 5 + [None] * 8 + ["z"] * 2
    texts = [prose(i, 5 + i % 17) for i in range(43)] + [None, ""]
    docs = make_docs(texts, sources=sources)
    rows = stored(mixing.measured(docs))
    got = mixing.apply_limits(rows, mixing.limits(rows, ranges=4)).collect()
    sizes: dict = {}
    for t, s in zip(texts, sources):
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = brute_targets(sizes), {}
    for r in got:
        assert r["__taken"] <= 3 * r["__size"] and abs(r["__target"] - want[r["source"]]) < 1e-6
        taken[r["source"]] = taken.get(r["source"], 0) + r["__taken"]
    assert len(got) == len(texts) and all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    for options in ({"ranges": 64}, {"ranges": 2, "few": 1}):
        again = mixing.apply_limits(rows, mixing.limits(rows, **options)).collect()
        assert sorted((r.doc_id, r["__taken"]) for r in again) == sorted((r.doc_id, r["__taken"]) for r in got)
    monkeypatch.setattr(mixing, "MANY", 1)  # sources beyond this are not broadcast
    again = mixing.apply_limits(rows, mixing.limits(rows)).collect()
    assert sorted((r.doc_id, r["__taken"]) for r in again) == sorted((r.doc_id, r["__taken"]) for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(taken.values())


def test_mixing_ties_nulls_and_nothing(spark, make_docs):
    docs = make_docs(["a b c"] * 4 + [None], ids=[1, 1, 1, None, None], sources=["s", "s", "s", "t", "t"])
    rows = mixing.measured(docs)
    assert sum(r["__taken"] for r in mixing.apply_limits(rows, mixing.limits(rows)).collect()) in range(10, 14)
    assert mixing.mix(make_docs([])).count() == 0
    assert mixing.mix(make_docs([None, ""])).count() == 0


def test_packing_round_trip(spark, make_docs, odd, prose):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    texts = [*odd, *(prose(i, 7 * i) for i in range(60)), "a <|endoftext|> b"]
    docs = make_docs(texts, ids=[None, *range(1, len(texts))])
    got = packing.pack(packing.pieces(docs, tokenizer_path(), keep=(F.col("doc_id"), F.col("taken").alias("row")), with_ids=True)).collect()
    by_row: dict[int, list] = {}
    for r in got:
        by_row.setdefault(r.row, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for i, t in enumerate(texts):
        parts = sorted(by_row[i], key=lambda r: r.piece)
        ids = [x for r in parts for x in r.ids]
        assert ids == [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        assert [r.start for r in parts] == list(np.cumsum([0, *(r.length for r in parts[:-1])])) and all(r.length == 1024 for r in parts[1:])
        assert len(parts) == -(-len(ids) // 1024)
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in got) // 1024) + 1
    assert packing.pack(packing.pieces(make_docs([]), tokenizer_path(), keep=(F.col("doc_id"),))).count() == 0


def test_packing_replaces_clashing_columns_and_spreads_equal_rows(spark, make_docs):
    docs = make_docs(["same text"] * 40).selectExpr("1L doc_id", "text", "'x' piece", "'x' offset", "'x' length", "'x' ids", "taken")
    made = packing.pieces(docs, tokenizer_path(), keep=tuple(F.col(c) for c in docs.columns))
    assert made.columns == ["doc_id", "text", "taken", "piece", "start", "length", "ids_crc32"]
    got = packing.pack(made.withColumn("offset", F.lit("x")).drop("taken"), per_group=10)
    assert got.columns[-2:] == ["sequence_id", "offset"]
    groups = [r["count"] for r in got.groupBy(F.col("sequence_id") % 4).count().collect()]
    assert sum(groups) == 40 and 1 < len(groups) <= 4


@pytest.mark.parametrize("seed", range(4))
def test_local_search_keeps_all_pieces_and_never_adds_bins(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, (100, 60, 55, 100)[seed], 300)
    bins = packing.best_fit(lengths, 100)
    better = packing.improve([list(b) for b in bins], lengths, 100)
    assert sorted(sum(better, [])) == list(range(300)) and len(better) <= len(bins)
    assert all(lengths[b].sum() <= 100 for b in better)


def test_local_search_of_many_large_pieces_is_quick():
    lengths = np.random.default_rng(1).integers(513, 1024, 20_000)
    start = time.perf_counter()
    assert len(packing.improve(packing.best_fit(lengths, 1024), lengths, 1024)) == 20_000 and time.perf_counter() - start < 10


def test_local_search_empties_a_bin_by_exchanges():
    lengths = np.array([6, 4, 5, 3, 2, 7, 3])  # 30 in all: three bins of 10
    loose = [[0, 2 - 1], [2, 3], [5], [4, 6]]
    assert len(packing.improve([list(b) for b in loose], lengths, 10)) == 3


@pytest.mark.parametrize("seed", range(3))
def test_local_search_ends_only_where_no_step_is_left(seed):
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([rng.integers(35, 70, 240), rng.integers(1, 9, 60)])
    bins = [[int(i)] for i in range(240)] + [list(range(240 + 15 * k, 255 + 15 * k)) for k in range(4)]
    bins = packing.improve(bins, lengths, 100)
    fill = [int(lengths[b].sum()) for b in bins]
    assert sorted(sum(bins, [])) == list(range(300)) and max(fill) <= 100
    if len(bins) * 100 - sum(fill) < 100:
        return
    for s, own in enumerate(bins):
        give = {int(lengths[p]) for p in own} | {int(lengths[p] + lengths[q]) for i, p in enumerate(own) for q in own[i + 1 :]}
        for t, other in enumerate(bins):
            if s != t and fill[s] < 100 and fill[t] < 100:
                for grown in {n - b for n in give for b in (0, *lengths[other].tolist())}:
                    assert not (0 < grown <= 100 - fill[t] and fill[t] - fill[s] + grown > 0)


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_the_corpus_queries():
    """The entry leaves them out quietly if they can't be imported; here they must be there."""
    import __spark_entry__

    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
