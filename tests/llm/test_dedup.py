import hashlib
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalogkit.llm import exact_dedup, line_dedup, near_dedup, substring_dedup
from catalogkit.llm.common import shared_dir
from catalogkit.llm.components import components


def saved(docs):
    path = shared_dir(docs.sparkSession)
    docs.write.parquet(path)
    return path


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, make_docs, odd, weak):
    """With a weak digest different texts collide, and the full texts tell them apart."""
    texts = [*odd, "É", "é", "K", "k", "K", "one"]
    digest = (lambda c: F.concat(F.lit("d"), F.length(c) % 2)) if weak else exact_dedup.sha256
    table = saved(make_docs(texts))
    got = {r.doc_id: r for r in exact_dedup.deduplicate(spark, table, digest=digest).collect()}
    files = {r.doc_id: r.file for r in spark.read.parquet(table).select("doc_id", F.col("_metadata.file_path").alias("file")).collect()}
    groups: dict[str, list[int]] = {}
    for i, t in enumerate(texts):
        groups.setdefault(lower(t), []).append(i)
    assert len(got) == len(texts)
    for same in groups.values():
        for i in same:
            assert (got[i].keep_id, got[i].group_size, got[i].locator) == (max(same), len(same), files[max(same)])
    if not weak:
        assert got[4].digest == hashlib.sha256(b"same text here").hexdigest()


def test_exact_dedup_nulls_repeats_and_nothing(spark, make_docs):
    got = exact_dedup.deduplicate(spark, saved(make_docs(["a", "a", "a", "b"], ids=[None, 3, 3, None]))).collect()
    assert sorted((r.keep_id is None, r.keep_id or 0, r.group_size) for r in got) == [(False, 3, 3)] * 3 + [(True, 0, 1)]
    assert exact_dedup.deduplicate(spark, saved(make_docs([]).limit(0).repartition(1))).count() == 0


def test_exact_dedup_hot_and_rare_texts_agree(spark, make_docs, monkeypatch):
    """Groups are the same whether their digest counts as hot (sent to all) or not."""
    texts = [["Hot", "warm", "WARM", "cold"][min(i % 7, 3)] + str(i if i % 7 > 3 else "") for i in range(60)]
    table = saved(make_docs(texts))
    found = []
    for most in (1_000, 4, 1):
        monkeypatch.setattr(exact_dedup, "MOST_HOT", most)
        found.append(sorted(tuple(r)[:4] for r in exact_dedup.deduplicate(spark, table).collect()))
    assert len(found[0]) == 60 and found[0] == found[1] == found[2]
    sizes = {i: sum(lower(t) == lower(x) for x in texts) for i, t in enumerate(texts)}
    assert all(r[3] == sizes[r[0]] for r in found[0])


def brute_components(texts, n, similarity=80):
    sets = []
    for t in texts:
        w = lower(t).encode().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and 100 * len(a & b) >= similarity * len(a | b) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return [len(s) for s in sets], root


def family(seed, sizes, edits):
    rng = random.Random(seed)
    out = []
    for size in sizes:
        base = [f"v{rng.randrange(10_000)}" for _ in range(size)]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(edits)):
                copy[rng.randrange(size)] = f"e{rng.randrange(10_000)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("n, most", [(2, (2048, 1 << 20)), (5, (2048, 1 << 20)), (2, (4, 300))])
def test_near_dedup_against_all_pairs(spark, make_docs, odd, n, most, monkeypatch):
    """Also with groups that are dealt to blocks, which share no more than one member in four."""
    monkeypatch.setattr(near_dedup, "SHARED", 1 if most[0] == 4 else 32)
    texts = [*odd[:-1], *family(n, (5, 8, 40, 70, 150, 400), 12)]
    random.Random(n).shuffle(texts)
    got = {r.id: r for r in near_dedup.groups(make_docs(texts), n=n, most=most).collect()}
    sizes, root = brute_components(texts, n)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id) == (sizes[i], root[i]), texts[i]


def test_overlaps_and_what_hangs_together():
    rng = random.Random(2)
    rows = [set(rng.sample(range(60), rng.randrange(1, 40))) | {0} for _ in range(80)]
    values, row = np.array([v for r in rows for v in sorted(r)]), np.repeat(np.arange(80), [len(r) for r in rows])
    i, j, shared = near_dedup.overlaps(values, row, 80)
    assert {(a, b): c for a, b, c in zip(i.tolist(), j.tolist(), shared.tolist())} == {(a, b): len(rows[a] & rows[b]) for b in range(80) for a in range(b)}
    assert near_dedup.hanging(7, np.array([5, 4, 1]), np.array([4, 2, 6])).tolist() == [0, 1, 2, 3, 2, 2, 1]
    batches = [pd.DataFrame({"group": g, "block": 0}) for g in ([1, 1, 2], [2], [2, 3], [3], [4])]
    assert [x["group"].tolist() for x in near_dedup.whole_groups(iter(batches))] == [[1, 1], [2, 2, 2], [3, 3], [4]]


@pytest.mark.parametrize("similarity, i, own", [(0.8, 12, 3), (0.8, 5, 1), (0.8, 4, 1)])
def test_similar_sets_are_listed_together(similarity, i, own):
    """Every way to put own values between the common ones of two sets leaves a run that both list."""
    for at in itertools.combinations_with_replacement(range(i + 1), own):
        for side in itertools.product((0, 1), repeat=own):
            sets = [[], []]
            for k in range(i + 1):
                for place, s in zip(at, side):
                    if place == k:
                        sets[s].append(f"{s} {len(sets[s])}")
                if k < i:
                    sets[0].append(k)
                    sets[1].append(k)
            keys = [{tuple(x[p : p + r]) for r in near_dedup.runs(len(x), similarity) for p in range(min(len(x), near_dedup.listed_values(len(x), r, similarity)) - r + 1)} for x in sets]
            assert keys[0] & keys[1]


def test_near_dedup_nulls_repeats_and_nothing(spark, make_docs):
    got = near_dedup.groups(make_docs(["a b c d e f"] * 4, ids=[None, 5, 5, 2])).collect()
    assert sorted((r.id is None, r.id or 0, r.component_id or 0) for r in got) == [(False, 2, 2), (False, 5, 2), (False, 5, 2), (True, 0, 0)]
    assert near_dedup.groups(make_docs([])).count() == 0


def test_near_dedup_rows_of_one_identifier_are_one_document(spark, make_docs):
    a, b, c = "a b c d e f", "g h i j k l", "m n o p q r"
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (7, ""), (11, None), (11, c), (20, "x y z u v w"), (20, None)]
    got = near_dedup.groups(make_docs([t for _, t in rows], ids=[i for i, _ in rows])).collect()
    assert sorted({(r.id, r.component_id) for r in got}) == [(3, 3), (5, 3), (7, 3), (9, 9), (11, 9), (20, 20)] and len(got) == len(rows)


def test_near_dedup_lists_unlike_members_of_a_hot_list_anew(spark, make_docs, monkeypatch):
    """Texts that share 70 words of 100: the rows that tasks compare grow with the texts, not with their square."""
    rng, common = random.Random(5), [f"common{i}" for i in range(28)]
    rows: list[int] = []
    task = near_dedup.by_estimate

    def unlike(n):
        made = [" ".join([*common, *(f"own{rng.randrange(10**9)}" for _ in range(12))]) for _ in range(n)]
        return made + [made[0] + " z", made[1] + " z"]

    def counting(*args):
        compare = task(*args)
        count = spark.sparkContext.accumulator(0)
        rows.append(count)

        def run(batches):
            def seen():
                for b in batches:
                    count.add(len(b))
                    yield b

            yield from compare(seen())

        return run

    monkeypatch.setattr(near_dedup, "by_estimate", counting)
    for n in (400, 800, 1_600):
        got = near_dedup.groups(make_docs(unlike(n)), n=1, most=(64, 1 << 20)).collect()
        assert sorted(r.id for r in got if r.id != r.component_id) == [n, n + 1]
    a, b, c = (x.value for x in rows)
    assert b < 2.3 * a and c < 2.3 * b


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    names = rng.sample(range(1000), 200)
    edges = list(zip(names[:60], names[1:61])) + [(names[70], x) for x in names[71:100]] + [(names[150], names[151])]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    for part in (names[:61], names[70:100], names[150:152]):
        assert {got[x] for x in part} == {min(part)}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def brute_substrings(ids, texts, window=13):
    rank = [2**63 if i is None else i for i in ids]
    words = [(t or "").encode().split() for t in texts]
    first: dict[tuple, int] = {}
    for r, w in sorted(zip(rank, words)):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), r)
    out = []
    for r, w in zip(rank, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < r:
                gone[k : k + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, y in zip(w, gone) if not y)).hexdigest()))
    return out


@pytest.mark.parametrize("chunk, bucket", [(1 << 22, 1 << 22), (2000, 100)])
def test_substring_dedup_against_brute_force(spark, make_docs, odd, prose, chunk, bucket):
    rng = random.Random(6)
    shared = [prose(100 + i, n) for i, n in enumerate((12, 13, 14, 20, 60))]
    texts = [" ".join([prose(i, rng.randrange(0, 40)), rng.choice(shared), prose(900 + i, rng.randrange(0, 30)), rng.choice(shared)]) for i in range(40)]
    texts += [*odd, texts[3], "a " * 30, "a " * 14, prose(1, 5) + "\x1f" + prose(2, 20)]
    ids = rng.sample(range(100), len(texts) - 1) + [None]
    got = {r.doc_id: tuple(r)[1:4] for r in substring_dedup.deduplicate(make_docs(texts, ids=ids), chunk=chunk, bucket=bucket).collect()}
    for i, want in zip(ids, brute_substrings(ids, texts)):
        assert got[i] == want


def test_substring_dedup_repeated_rows_and_nothing(spark, make_docs, prose):
    got = substring_dedup.deduplicate(make_docs([prose(1, 30)] * 3, ids=[4, 4, 9])).collect()
    assert sorted((r.doc_id, r.n_removed, len(r.kept_text.split())) for r in got) == [(4, 0, 30), (4, 0, 30), (9, 30, 0)]
    assert substring_dedup.deduplicate(make_docs([])).count() == 0
    got = substring_dedup.deduplicate(make_docs([prose(1, 30)] * 3 + [prose(1, 20) + " " + prose(2, 20)], ids=[None, None, (1 << 60) + 1, None]), keep=(F.col("taken"),)).orderBy("taken").collect()
    assert [(r.doc_id, r.n_removed) for r in got] == [(None, 30), (None, 30), ((1 << 60) + 1, 0), (None, 20)]


@pytest.mark.parametrize("max_sent", [10_000, 0])
def test_line_dedup_drops_recurring_templates(spark, make_docs, odd, prose, max_sent):
    body = [prose(500 + i, 12) for i in range(8)]
    texts = [f"{body[i]}\nPosted by user {'abcdefgh'[i]} on the daily board today at noon\nViewed {i} times so far\nok\n" for i in range(8)]
    texts += [*odd, body[0]]
    got = {r.doc_id: r for r in line_dedup.deduplicate(make_docs(texts), max_sent=max_sent).collect()}
    assert got[0].text == texts[0] and got[0].n_dropped == 0
    for i in range(1, 8):
        assert got[i].text == f"{body[i]}\nok\n" and (got[i].n_lines, got[i].n_dropped) == (5, 2)
    assert got[8].text is None and got[8].n_lines == 1 and got[9].text == ""
    assert got[17].text == body[0]
    assert line_dedup.deduplicate(make_docs([])).count() == 0


def test_line_dedup_null_and_repeated_ids(spark, make_docs):
    texts = ["a line that comes again and again"] * 6
    got = line_dedup.deduplicate(make_docs(texts, ids=[None, None, 3, 3, 4, 5])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_dropped) for r in got) == [(False, 3, 0), (False, 3, 0), (False, 4, 1), (False, 5, 1), (True, 0, 1), (True, 0, 1)]


@pytest.mark.parametrize("max_sent", [1000, 0])
def test_line_dedup_without_identifiers_keeps_the_first_line_only(spark, make_docs, max_sent):
    texts = [f"own {x} words of this text\na line that comes again and again" for x in "abcdefgh"]
    got = line_dedup.deduplicate(make_docs(texts, ids=[None] * 8), max_sent=max_sent).collect()
    assert sum(r.n_dropped for r in got) == 7 and sorted(r.n_dropped for r in got) == [0] + [1] * 7
    got = line_dedup.deduplicate(make_docs(texts, ids=[None] * 7 + [(1 << 63) - 1]), max_sent=max_sent).collect()
    assert [r.n_dropped for r in got if r.doc_id] == [0] and sum(r.n_dropped for r in got) == 7


@pytest.mark.parametrize("max_sent", [1000, 0])
def test_line_dedup_whole_lines_in_two_documents_and_plain_word_fields(spark, make_docs, prose, max_sent):
    names = ["alice", "bob", "carol", "dave", "erin"]
    texts = [f"{prose(500 + i, 20)}\nPosted by {x}\nok\nour shop in {x} sells {x} and more {x} than all others here" for i, x in enumerate(names)]
    passage = prose(600, 60)
    texts += [f"{passage}\nonly {i} here" for i in range(2)]
    docs = make_docs(texts)
    got = {r.doc_id: r for r in line_dedup.deduplicate(docs, max_sent=max_sent, wide=True, exact_docs=2).collect()}
    assert got[0].text == texts[0] and got[5].text == texts[5] and got[6].text == "only 1 here"
    assert all(got[i].text == texts[i].split("\n")[0] for i in range(1, 5))
    assert all(r.n_dropped == 0 for r in line_dedup.deduplicate(docs, max_sent=max_sent).collect())


def test_line_dedup_sends_the_templates_of_most_documents(spark, make_docs, prose):
    lines = [prose(700 + k, 9) for k in range(12)]
    texts = ["\n".join([prose(800 + i, 11), *(x for k, x in enumerate(lines) if i % (k + 1) == 0)]) for i in range(120)]
    docs = make_docs(texts)
    found = line_dedup.recurring_templates(docs, "doc_id", "text", 3, 5, 3)
    counts = sorted((r.n for r in found.collect()), reverse=True)
    for most in (0, 10, 40, 10_000):
        least = line_dedup.sent_from(found, most)
        assert sum(n >= least for n in counts) <= most and (most < 10_000 or least == 1)
    want = sorted(map(tuple, line_dedup.deduplicate(docs).collect()))
    for most in (40, 0):
        assert sorted(map(tuple, line_dedup.deduplicate(docs, max_sent=most).collect())) == want
    assert sum(r[-1] for r in want) > 200


def test_template_keys_are_compared_in_full():
    known = np.array([[1, 5, 5, 5, 9], [7, 1, 2, 3, 0]])
    keys = np.array([[5, 5, 5, 1, 0, 9, 10, 9], [3, 1, 4, 7, 0, 0, 0, 1]])
    assert line_dedup.find(known, keys).tolist() == [3, 1, -1, 0, -1, 4, -1, -1]
    assert line_dedup.find(known[:, :0], keys).tolist() == [-1] * 8
    assert line_dedup.as_longs([]).shape == (2, 0)
