"""Fill-in-middle cuts and token files."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogkit.llm import fim, token_files
from catalogkit.llm.common import shared_dir
from catalogkit.llm.queries import tokenizer_path

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("offsets", [[0], range(0, 300_000, 3), range(5, 70_000), [0, 7, 65_535, 65_536, 200_000], sorted(random.Random(1).sample(range(400_000), 90_000)), [*range(10), *range(100_000, 165_536)]])
def test_offset_set_selects_by_rank(offsets):
    offsets = np.array(list(offsets), np.int64)
    held = fim.OffsetSet(offsets)
    assert len(held) == len(offsets)
    at = range(len(offsets)) if len(offsets) < 100 else [0, 1, len(offsets) // 2, len(offsets) - 1, *random.Random(2).sample(range(len(offsets)), 200)]
    assert [held.select(k) for k in at] == [int(offsets[k]) for k in at]


def test_offset_sets_take_the_smallest_container():
    kinds = [fim.container(np.array(x))[0] for x in ([1, 5, 9], range(0, 65_536, 2), range(3, 60_000))]
    assert kinds == [fim.ARRAY, fim.BITMAP, fim.RUN]


def test_fill_in_middle_against_brute_force(spark, make_docs, odd, prose):
    texts = [*odd, *(prose(i, 3 * i) for i in range(120)), " lead and trail \n", "　no break\x1cspace\x85", "has <P> marker words", "<S>", "<<M> < P>", "ä\tb\x0bc 腾讯 𝄞 x " * 9_000, "< S> <P <M " * 40]
    ids = [None, *range(1, len(texts))]
    made = fim.transform(make_docs(texts, ids=ids).withColumn("form", F.lit("x")))
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "taken", "key", *fim.RESULTS]
    got = {r.taken: r for r in made.withColumn("back", fim.restored(F.col("fim_text"), F.col("form"))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.fim_text) == brute_fim(ids[i], t), t
        assert r.back == (t or "")
    assert {r.form for r in got.values()} == {"plain", "spm", "psm"}


def test_fill_in_middle_of_repeats_and_nothing(spark, make_docs):
    got = fim.transform(make_docs(["a b c d e f"] * 3, ids=[7, 7, None])).select("doc_id", "form", "fim_text").distinct().count()
    assert got == 2
    assert fim.transform(make_docs([])).count() == 0


def whole_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids, 2]


ODDER = ["<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "don't I'll we've 'S 's' ''", "É́ é ́x ́", "a\x1cb\x85c d　e\xa0f", "ΑΣ ΑΣ. Σ", "İstanbul ǅ", "\x0b\x0c\r\n", "12345 3.14 ½ ²", "𝄞𝄞 🙂🙂🏽", "\x00\x01"]


def test_words_give_the_ids_of_whole_texts(prose):
    encode = token_files.encoder(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(3)
    letters = "aAeEéÉ́ß'sStTdDlL .,;!?\t\n\r\x0b\x0c\x1c\x85\xa0 　腾讯12½Σσς<|endoftext|>🙂"
    texts = [*ODDER, "", *("".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2_000)), prose(1, 500)]
    latin = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100), 0x130, 0x131, 0x17F, 0x212A)]
    texts += [" ".join("".join(rng.choice(latin) for _ in range(rng.randrange(1, 12))) + rng.choice(["", ",", "?!", "'s", "-", "\u0301", "\u0301."]) for _ in range(40)) for _ in range(300)]
    n, ids = encode(texts)
    parts = np.split(ids, np.cumsum(n)[:-1])
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    assert [p.tolist() for p in parts] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert token_files.splits_at_space(tokenizer_path("word_bpe_49k.json")) and not token_files.splits_at_space(tokenizer_path())


def test_words_are_forgotten_in_time(monkeypatch):
    monkeypatch.setattr(token_files, "MOST_KNOWN", 10)
    token_files.encoder.cache_clear()
    encode = token_files.encoder(tokenizer_path("word_bpe_49k.json"))
    for texts in (["some words here", ""], ["other words there", "some"], ["", "some words here"]):
        n, ids = encode(texts)
        assert ids.tolist() == [i for t in texts for i in whole_ids(t)[:-1]] and n.tolist() == [len(whole_ids(t)) - 1 for t in texts]
    token_files.encoder.cache_clear()


def test_token_files_round_trip(spark, make_docs, odd, prose):
    texts = [*odd, *ODDER, *(prose(i, 5 * i) for i in range(80))]
    ids = [None, 900, *range(2, len(texts))][::-1]
    docs = make_docs(texts, ids=ids).withColumn("start", F.lit("x"))
    path = shared_dir(spark)
    token_files.write(docs, path, tokenizer_path("word_bpe_49k.json"), files=3)
    got = {r.doc_id: r for r in token_files.read(spark, path).collect()}
    crcs = {r.doc_id: r.ids_crc32 for r in token_files.with_crc32(token_files.read(spark, path)).collect()}
    at = 0
    for i, t in sorted(zip(ids, texts), key=lambda x: -1 if x[0] is None else x[0]):
        want = whole_ids(t)
        assert (got[i].start, got[i].n_tokens, got[i].ids) == (at, len(want), want)
        assert crcs[i] == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    files = sorted(token_files.manifest(spark, path).collect(), key=lambda r: r.number)
    assert len(files) == 3 and sum(r.documents for r in files) == len(texts) and sum(r.tokens for r in files) == at
    assert [r.start for r in files] == list(np.cumsum([0, *(r.tokens for r in files)])[:-1])
    assert sorted(r.doc_id for r in token_files.look_up(spark, path, [900, 5, 77_777]).collect()) == [5, 900]
    assert token_files.look_up(spark, path, []).count() == 0


def test_token_files_of_repeats_ties_and_nothing(spark, make_docs):
    path = shared_dir(spark)
    token_files.write(make_docs(["same"] * 60 + ["b c", "a"], ids=[1] * 62), path, tokenizer_path("word_bpe_49k.json"), files=4)
    got = token_files.read(spark, path).orderBy("start").collect()
    assert len(got) == 62 and sum(r.n_tokens for r in got) == got[-1].start + got[-1].n_tokens
    assert token_files.manifest(spark, path).where("documents > 0").count() > 1  # one id is spread over files
    path = shared_dir(spark)
    token_files.write(make_docs([]), path, tokenizer_path("word_bpe_49k.json"))
    assert token_files.read(spark, path).count() == 0 and token_files.look_up(spark, path, [1]).count() == 0


def test_token_files_have_stripes_and_prune_row_groups(spark, make_docs):
    from pyarrow import orc

    n = 40_000
    docs = spark.range(n).select((F.col("id") * 2).alias("doc_id"), F.concat_ws(" ", *(F.md5(F.concat("id", F.lit(x)).cast("binary")) for x in "abcdef")).alias("text"))
    path = shared_dir(spark)
    token_files.write(docs, path, tokenizer_path("word_bpe_49k.json"), files=2, stripe_bytes=1 << 20)
    listed = [r.file.removeprefix("file:") for r in token_files.manifest(spark, path).where("documents > 0").collect()]
    stripes = [orc.ORCFile(f).nstripes for f in listed]
    assert min(stripes) > 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert token_files.read(spark, path).rdd.getNumPartitions() > len(listed)  # tasks share a file by stripes
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = token_files.look_up(spark, path, [60_000])
    assert found.count() == 1
    assert "In(doc_id, [60000])" in found._jdf.queryExecution().toString() or "EqualTo(doc_id,60000)" in found._jdf.queryExecution().toString()

    def rows_scanned(df):
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
        scans = plan.collectLeaves()
        return sum(scans.apply(i).metrics().apply("numOutputRows").value() for i in range(scans.size()))

    assert rows_scanned(found) <= 1_000  # one row group of 1,000
    assert rows_scanned(token_files.look_up(spark, path, [60_001])) == 0  # between two ids: the Bloom filter knows
