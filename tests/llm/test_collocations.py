import random
import re
from collections import Counter

import numpy as np
import pytest

from catalogkit.llm import collocations


def brute(rows, least=30, most=2_000):
    """(lang, rank, phrase, a, l, r, n, score) by plain counting."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = []
    often = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    longest = Counter()
    for (lang, p), a in often.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p):
                    longest[lang, p[i:j]] = max(longest[lang, p[i:j]], a)
    for (lang, p), a in often.items():
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        if 100 * longest[lang, p] < 80 * a:
            found.append((lang, " ".join(p), a, left, right, n[lang], score))
    out = []
    for lang in n:
        own = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(lang, i, *x[1:]) for i, x in enumerate(own[:most], 1)]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "hall", "a", "a", "b", "été", "x-y", *(f"w{i}" for i in range(40))]
    made = []
    for _ in range(n):
        t = "".join(rng.choice(words) + rng.choice([" "] * 12 + ["\t", "  ", ". ", "\n", "!?", ", "]) for _ in range(rng.randrange(40)))
        made.append(t + rng.choice(["", "New York city hall", "of the of the of the", " a a a a a a"]))
    return made


@pytest.mark.parametrize("chunk, hot_share", [(2_000_000, 2_000), (500, 20), (64, 2_000_000)])
def test_collocations_against_plain_counts(spark, make_docs, odd, chunk, hot_share):
    docs = [*odd[:-1], *texts(1, 400), *["copies of one text. copies of one text"] * 60]
    langs = [random.Random(i).choice(["en", "de", None, "und"]) for i in range(len(docs))]
    got = collocations.mine(make_docs(docs, langs=langs), chunk=chunk, hot_share=hot_share).collect()
    assert sorted(map(tuple, got)) == brute(zip(langs, docs)) and len(got) > 10


def test_collocations_keep_the_best_with_ties(spark, make_docs):
    docs = [" ".join(f"{x}{i} {y}{i}." for i in range(30)) for x, y in ("ab", "cd")] * 30
    rows = [("en", t) for t in docs]
    got = collocations.mine(make_docs(docs), most=7).collect()
    assert sorted(map(tuple, got)) == brute(rows, most=7) and len(got) == 7  # all score alike: the phrase decides


def test_collocations_take_another_seed_when_words_share_a_hash(spark, make_docs, monkeypatch):
    first = collocations.code
    monkeypatch.setattr(collocations, "code", lambda lang, word, seed: first(lang, word, seed) % 5 if seed == 0 else first(lang, word, seed))
    docs = ["new york city"] * 40
    got = collocations.mine(make_docs(docs)).collect()
    assert sorted(map(tuple, got)) == brute([("en", t) for t in docs])


def test_collocations_of_a_long_text_and_of_nothing(spark, make_docs):
    docs = ["one long text with words " * 20_000]
    got = collocations.mine(make_docs(docs), chunk=1_000).collect()
    assert sorted(map(tuple, got)) == brute([("en", docs[0])])
    assert collocations.mine(make_docs([])).count() == 0
    assert collocations.mine(make_docs(["a b c", None])).count() == 0


def test_equal_partitions_are_counts():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 6, (4, 3_000)) ** 2
    w[1:, rng.random(3_000) < 0.2] = 0
    w[2:] = np.where(w[1] == 0, 0, w[2:])
    w[3] = np.where(w[2] == 0, 0, w[3])
    weight = rng.integers(1, 4, 3_000)
    want = Counter()
    for i in range(3_000):
        for k in range(1, 5):
            if w[k - 1, i] == 0:
                break
            want[tuple(w[:k, i].tolist())] += int(weight[i])
    got = {tuple(w[:k, i].tolist()): size for k, i, size in collocations.equal_partitions(w, weight, 30, 1)}
    assert got == {p: n for p, n in want.items() if n >= 30}
