"""The stages of the corpus pipeline, each held against plain Python on its own input."""

import collections
import random

import corpus_pipeline
from catalogkit.llm.common import stored
from catalogkit.llm.line_dedup import template_keys
from catalogkit.llm.queries import tokenizer_path

WORDS = ["tan", "mel", "rus", "dok", "fen", "gil", "hov", "jas", "kub", "lim", "nop", "pra", "sto", "vex", "wir", "zem"]


def words(rng, n):
    return " ".join("".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(n))


def corpus():
    rng = random.Random(11)
    texts = [f"{words(rng, rng.randint(60, 120))}\n{words(rng, 30)}" for _ in range(60)]
    texts += [f"{words(rng, 80)}\nPosted here today by {words(rng, 1)} on the board at noon" for _ in range(8)]
    texts += [t.replace("tan", "tan ", 1) + " " + words(rng, 3) for t in texts[:6]]
    texts += [" ".join(f"{w}##" for w in words(rng, 70).split()) for _ in range(8)]
    texts += [None, "", "too short", texts[0]]
    return [(i, t, "en", f"s{i % 3}" if i % 10 else None, len(t or "")) for i, t in enumerate(texts)]


def shingle_set(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_stages(spark, tmp_path):
    rows = corpus()
    junk = {i for i, t, *_ in rows if t and "##" in t}
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i not in junk), 0) for i, *_ in rows], "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, at = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)))
        at.append([r.asDict() for r in docs.collect()])
    assert all(list(r) == columns for part in at[:-1] for r in part)

    # quality rules: short and junk documents go, the clean ones stay unchanged
    kept = {r["doc_id"]: r["text"] for r in at[0]}
    clean = {i: t for i, t, *_ in rows if t and i not in junk and len(t.split()) >= 50}
    assert not junk & set(kept) and set(kept) <= set(clean) and len(kept) >= len(clean) - 1
    assert all(kept[i] == clean[i] for i in kept)

    # line dedup: lines with a template of five documents or more stay in the first of them only
    seen = collections.defaultdict(set)
    for i, t in kept.items():
        for line in t.split("\n"):
            for key in template_keys(line.encode(), 3, 3):
                seen[key].add(i)
    want = {}
    for i, t in kept.items():
        lines = [x for x in t.split("\n") if not any(len(seen[k]) >= 5 and min(seen[k]) != i for k in template_keys(x.encode(), 3, 3))]
        if "".join(lines).split():
            want[i] = "\n".join(lines)
    left = {r["doc_id"]: r["text"] for r in at[1]}
    assert left == want and sum("Posted here" in t for t in left.values()) == 1
    assert all(r["n_chars"] == len(r["text"]) for r in at[1])

    # near dedup: the smallest identifier of each group
    ids = sorted(left)
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            a, b = shingle_set(left[i]), shingle_set(left[j])
            if j < i and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert sorted(r["doc_id"] for r in at[2]) == sorted(i for i in ids if root[i] == i)

    # mixing: whole passes, then a part; words add up to the words of the input
    size = {r["doc_id"]: len(r["text"].split()) for r in at[2]}
    taken = collections.Counter()
    for r in at[3]:
        taken[r["doc_id"]] += len(r["text"].split())
    assert all(taken[i] <= 3 * size[i] for i in taken) and abs(sum(taken.values()) - sum(size.values())) <= 4

    # packing: every token of every row has one place
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    tokens = collections.Counter()
    for r in at[3]:
        tokens[r["doc_id"]] += len(whole.encode(r["text"], add_special_tokens=False).ids) + 1
    placed, fill = collections.Counter(), collections.Counter()
    for r in at[4]:
        placed[r["doc_id"]] += r["length"]
        fill[r["sequence_id"]] += r["length"]
    assert placed == tokens and max(fill.values()) <= 1024 and len(fill) <= -(-sum(fill.values()) // 1024) + 1

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in at[4])


def test_near_copies_stay_once_without_and_with_repeated_identifiers(spark, make_docs, prose):
    a, b, c = (prose(i, 40) for i in range(3))
    docs = make_docs([a, a, a, b, b, None, c, c + " x"], ids=[5, 5, None, None, None, None, 7, 9])
    got = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(5, a), (0, b), (0, ""), (7, c)])


def test_stages_of_nothing(spark, make_docs):
    docs = make_docs([])
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, "")
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == docs.columns)


def test_pipeline_over_an_empty_table_and_after_a_stage_that_keeps_nothing(spark, make_docs, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, docs in {"empty": make_docs([]), "short": make_docs(["too short", None])}.items():
        docs.select(columns).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() == 0
