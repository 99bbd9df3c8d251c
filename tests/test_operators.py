import random
import time

import pytest
from pyspark.sql import functions as F

from catalogkit.operators import analytics, curate, itembank, links, resolve, rules
from catalogkit.plans.pages import kept


def test_first_rule_wins_and_null_conditions_do_not_hold(spark):
    df = spark.createDataFrame([(1, None), (2, True)], "id int, flag boolean")
    got = {r.id: r.x for r in df.select("id", rules.first_rule([("a", F.col("flag")), (None, F.col("id") == 1), ("b", F.lit(True))]).alias("x")).collect()}
    assert got == {1: None, 2: "a"}


def test_exclusion_chain(spark):
    rows = [
        ("svglogo", "a.svg", "t", True, True, "wordmark_or_visible_answer"), ("svglogo", "a.svg", "t", False, False, None), ("gilbarbara", "x/aws-s3.svg", "t", False, True, "aws_service_icon"),
        ("thesvg", "a/public/icons/b/mono.svg", "t", False, True, "thesvg_non_brand_primary_variant"), ("other", "a/favicon.ico", "t", False, True, "site_internal_icon"),
        ("other", "a/logos/64.png", "t", False, True, "generic_size_icon"), ("other", "a/x.png", "t", False, False, "not_popular_quiz_brand"), ("other", "a/x.png", "t", False, True, None),
    ]
    df = spark.createDataFrame(rows, "source string, path string, title string, wordmark boolean, allowed boolean, want string")
    chain = rules.exclusion_rules(*map(F.col, ("source", "path", "title", "wordmark", "allowed")))
    assert df.where(~rules.first_rule(chain).eqNullSafe(F.col("want"))).count() == 0


def test_rule_match_gives_the_first_rule_of_a_pair(spark):
    e = spark.createDataFrame([("e1", "A", "a.com"), ("e2", "", None)], "entity_id string, name string, domain string")
    r = spark.createDataFrame([("r1", "A", "a.com"), ("r2", "A", ""), ("r3", "", None)], "record_id string, name string, domain string")
    got = resolve.rule_match(e, r, [("domain", "high", F.col("domain"), F.col("domain")), ("name", "medium", F.col("name"), F.col("name"))])
    assert sorted(map(tuple, got.collect())) == [("e1", "r1", "domain", "high"), ("e1", "r2", "name", "medium")]


def test_containment_against_all_pairs(spark):
    rng = random.Random(1)
    a = [(i, "".join(rng.choices("abc", k=rng.randint(1, 9)))) for i in range(60)]
    b = [(i, "".join(rng.choices("abc", k=rng.randint(1, 9)))) for i in range(60)]
    got = resolve.containment_pairs(spark.createDataFrame(a, "x int, key string"), spark.createDataFrame(b, "y int, key string"), "x", "y")
    want = {(i, j) for i, s in a for j, t in b if s == t or (len(s) >= 4 and s in t) or (len(t) >= 4 and t in s)}
    assert {tuple(r) for r in got.collect()} == want
    common = [(1, "northbank"), (2, "bank"), (3, "bankzq")], [(i, f"bank{i:04d}") for i in range(50)] + [(77, "oldnorthbankzq"), (None, "bankzq")]
    got = resolve.containment_pairs(spark.createDataFrame(common[0], "x int, key string"), spark.createDataFrame(common[1], "y int, key string"), "x", "y")
    assert {tuple(r) for r in got.collect()} == {(2, i) for i in range(50)} | {(1, 77), (2, 77), (3, 77), (2, None), (3, None)}


def test_search_score(spark):
    df = spark.createDataFrame([("acme", "Acme", "Acme", "a software company", "Q1", 105), ("acme", "Acme", "Acme", "a film", "Q1", 40), ("acme", "Acme", "Acme Inc", "", "P1", 54), ("x", "qq", "zz", "bank", "Q2", 15)], "e string, q string, l string, d string, i string, want int")
    assert df.where(resolve.search_score(*map(F.col, "eqldi")) != F.col("want")).count() == 0


def test_first_wins_and_precedence(spark):
    a, b = spark.createDataFrame([("k", "1"), ("", "x")], "id string, v string"), spark.createDataFrame([("k", "2"), ("m", "3")], "id string, v string")
    assert sorted(map(tuple, resolve.first_wins([a, b], "id").collect())) == [("k", "1"), ("m", "3")]
    base = spark.createDataFrame([("k", "raw"), ("z", None)], "id string, v string")
    layers = [spark.createDataFrame([("k", " ")], "id string, v string"), a]
    got = resolve.precedence_fill(base, layers, "id", ("v",), {"v": "none"})
    assert sorted(map(tuple, got.collect())) == [("k", "1"), ("z", "none")]


def test_work_list_and_upsert(spark):
    e = spark.createDataFrame([("a", "x.io"), ("b", ""), ("c", "y.io")], "id string, domain string")
    got = resolve.work_list(e, spark.createDataFrame([("c",), ("c",)], "id string"), "id", "domain")
    assert {r.id: r.skip_reason for r in got.collect()} == {"a": None, "b": "no_domain", "c": "covered"}
    old, new = spark.createDataFrame([("a", 1, "o"), ("b", 5, "o")], "id string, at int, v string"), spark.createDataFrame([("a", 1, "n"), ("b", 4, "n")], "id string, at int, v string")
    assert {r.id: r.v for r in resolve.upsert_latest(old, new, "id", "at").collect()} == {"a": "n", "b": "o"}


def test_best_per_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("k", 2, 5), ("k", 1, 5), ("k", 3, 4)], "key string, ord int, p int")
    assert [tuple(r) for r in curate.best_per(df, "key", F.col("p"), ("ord",)).select("key", "ord").collect()] == [("k", 1)]


def test_copies_spare_the_protected_and_the_keyless(spark):
    df = spark.createDataFrame([(1, "k", 1, False), (2, "k", 9, False), (3, "k", 0, True), (4, None, 0, False)], "id int, key string, p int, safe boolean")
    got = curate.mark_copies(df, "key", "id", F.col("p"), ("id",), F.col("safe"))
    assert {r.id: r.duplicate_of for r in got.collect()} == {1: 2, 2: None, 3: None, 4: None}


def sequential_ids(bases):
    used, out = set(), []
    for base in bases:
        own, k = base, 2
        while own in used:
            own, k = f"{base}_{k}", k + 1
        used.add(own)
        out.append(own)
    return out


def test_unique_ids_equal_a_sequential_pass(spark, keep):
    rng = random.Random(5)
    hot = [rng.choice(["a"] * 8 + ["a_2", "a_3", "a_9", "a_9_2", "a_9_2", "a_40", "a_41", "a_02", "a_1", "b", "b_2"]) for _ in range(250)]
    chain = [*(f"a_{k}" for k in range(9, 1, -1)), *["a"] * 9, *(f"a_{k}" for k in range(2, 15))]
    for bases in (["a", "a", "a_2", "a"], ["a_2", "a", "a", "a_2"], ["a", "a", "a_2", "a_2_x"], [rng.choice(["a", "a_2", "a_3", "a_2_2", "b", "b_x", "c_1"]) for _ in range(60)], hot, chain):
        rows = [(i, b) for i, b in enumerate(bases)] + [(1_000, None), (1_001, None)]
        df = spark.createDataFrame(rows, "o int, base string")
        got = {r.o: r.unique_id for r in curate.unique_ids(df, "base", ("o",), keep).collect()}
        assert [got[i] for i in range(len(bases))] == sequential_ids(bases)
        assert len(got) == len(rows) and got[1_000] is None and got[1_001] is None
    assert curate.unique_ids(spark.createDataFrame([], "o int, base string"), "base", ("o",), keep).count() == 0


@pytest.mark.parametrize("n", [10, 64, 128, 200, 256])
def test_average_hash_of_any_length(spark, n):
    rng = random.Random(n)
    rows = [(0, [0.0] * (n // 2) + [1.0] * (n - n // 2)), (1, [1.0] * (n // 2) + [0.0] * (n - n // 2)), (2, [rng.random() for _ in range(n)])]
    got = {r.id: r.code for r in spark.createDataFrame(rows, "id int, x array<double>").select("id", curate.average_hash(F.col("x")).alias("code")).collect()}
    for i, x in rows:
        bits = sum(1 << k for k, v in enumerate(x) if v >= sum(x) / n)
        assert [w % (1 << 64) for w in got[i]] == [bits >> 64 * k & (1 << 64) - 1 for k in range(-(-n // 64))]
    two = spark.createDataFrame([([1, 2], [1]), ([1, 2], [0, 2])], "a array<bigint>, b array<bigint>")
    assert [r.d for r in two.select(curate.hamming(F.col("a"), F.col("b")).alias("d")).collect()] == [(1 << 31) - 1, 1]


def test_bands_against_all_pairs(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(256) for _ in range(10)]
    codes = [(i, base[i % 10] ^ sum(1 << rng.randrange(256) for _ in range(rng.randint(0, 3)))) for i in range(80)]
    signed = lambda w: w - (1 << 64) if w >> 63 else w
    df = spark.createDataFrame([(i, [signed(c >> 64 * k & (1 << 64) - 1) for k in range(4)]) for i, c in codes], "id int, code array<bigint>")
    got = {(r.a, r.b, r.distance) for r in curate.banded_pairs(df, "id", "code", 4).collect()}
    first = {x: i for i, x in reversed(codes)}  # equal hashes go by their smallest record
    assert got == {(i, j, (x ^ y).bit_count()) for x, i in first.items() for y, j in first.items() if i < j and (x ^ y).bit_count() <= 4}
    assert {r.id: r["class"] for r in curate.hash_classes(df, "id", "code").collect()} == {i: first[x] for i, x in codes}


@pytest.mark.parametrize("seed", range(3))
def test_greedy_pass_equals_a_sequential_one(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.08}
    order, safe = [rng.randrange(8) for _ in range(n)], [rng.random() < 0.2 for _ in range(n)]
    keep: list[int] = []
    for i in sorted(range(n), key=lambda i: (order[i], i)):
        if safe[i] or not any((min(i, k), max(i, k)) in edges for k in keep):
            keep.append(i)
    df = spark.createDataFrame([(i, order[i], safe[i]) for i in range(n)], "id int, o int, safe boolean")
    got = curate.greedy_near_copies(df, spark.createDataFrame(sorted(edges), "a int, b int"), "id", F.col("o"), F.col("safe"), kept)
    assert sorted(r.id for r in got.where("state = 'kept'").collect()) == sorted(keep)


def test_bounds_ratio(spark):
    cells = [0.0] * 64
    for i in (9, 10, 11, 12, 17):
        cells[i] = 50.0
    df = spark.createDataFrame([(cells,), ([0.0] * 64,)], "c array<double>")
    assert [r[0] for r in df.select(curate.bounds_ratio(F.col("c"), 8)).collect()] == [2.0, 0.0]


def lcg(n, seed):
    out, s = list(range(n)), seed or 123456789
    for i in range(n - 1, 0, -1):
        s = (s * 1664525 + 1013904223) & 0xFFFFFFFF
        j = s % (i + 1)
        out[i], out[j] = out[j], out[i]
    return out


def test_lcg_permutation(spark):
    cases = [(n, s) for n in (1, 2, 5, 17) for s in (0, 1, 31, 99999)]
    df = spark.createDataFrame(cases, "n int, s int")
    for r in df.select("n", "s", itembank.lcg_permutation(F.col("n"), F.col("s")).alias("p")).collect():
        assert r.p == lcg(r.n, r.s)


def test_distractors_use_up_earlier_tiers_first(spark):
    rng = random.Random(3)
    rows = [(i, f"g{rng.randrange(9)}", f"c{rng.randrange(3)}") for i in range(40)]
    group, category = {i: g for i, g, _ in rows}, {i: c for i, _, c in rows}
    found: dict[int, list] = {}
    for r in itembank.distractors(spark.createDataFrame(rows, "e int, g string, c string"), "e", ("g", "c", None)).collect():
        found.setdefault(r.answer, []).append(r.option)
    for i in group:
        options = found[i]
        same = {j for j in group if j != i and group[j] == group[i]}
        near = {j for j in group if j != i and category[j] == category[i]} - same
        assert len(set(options)) == 3 and i not in options
        assert len(same & set(options)) == min(3, len(same))
        assert len(near & set(options)) == min(3 - min(3, len(same)), len(near))


def test_small_catalog_gives_no_items(spark):
    df = spark.createDataFrame([(i, "g", "c") for i in range(3)], "e int, g string, c string")
    assert itembank.item_bank(df, "e", "g", "c").count() == 0


def test_mixed_pick_is_disjoint(spark):
    df = spark.createDataFrame([(i, f"g{i % 3}", f"c{i % 5}") for i in range(30)], "e int, g string, c string")
    got = itembank.mixed_pick(itembank.item_bank(df, "e", "g", "c"), 9, "s", "logo_to_brand", "brand_to_logo").collect()
    assert len(got) == 9 and len({r.answer for r in got}) == 9 and sum(r.type == "logo_to_brand" for r in got) == 5


def test_group_stats_and_metrics(spark):
    df = spark.createDataFrame([(1, "a", True, 10), (2, "a", False, 30), (3, None, True, 10), (4, " ", True, 7)], "ord int, g string, correct boolean, latency int")
    got = {r.g: tuple(r)[1:] for r in analytics.group_stats(df, "g", default="none").collect()}
    assert got == {"a": (2, 1, 50, 20), "none": (2, 2, 100, 9)}
    m = analytics.core_metrics(df, "ord").first()
    assert tuple(m) == (7, 4, 30, 2)


def test_icon_links(spark):
    html = '<link rel="shortcut icon" href="/f.ico"><link rel="apple-touch-icon" sizes="180x180" href="t.png"><meta property="og:image" content="//c.io/o.png"><link rel="manifest" href="/m.json"><link rel="mask-icon" href="">'
    df = spark.createDataFrame([(1, "https://h.io/d/p", html)], "id int, url string, html string")
    got = {(r.kind, r.icon_url, r.size, r.priority) for r in links.icon_links(df, "id", "url", "html").collect()}
    assert got == {("icon", "https://h.io/f.ico", 0, 50), ("apple-touch-icon", "https://h.io/d/t.png", 180, 80), ("og:image", "https://c.io/o.png", 0, 20), ("manifest-link", "https://h.io/m.json", 0, 10)}
    m = spark.createDataFrame([(1, "https://h.io/m.json", [("i.png", "512x512")])], "id int, url string, icons array<struct<src:string,sizes:string>>")
    assert [(r.icon_url, r.size, r.priority) for r in links.manifest_icons(m, "id", "url").collect()] == [("https://h.io/i.png", 512, 100)]


def test_faceted_pages(spark):
    df = spark.range(10).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("s"), F.concat(F.lit("Item "), "id").alias("t"))
    got = rules.faceted(df, {"s": "a", "t": None}, "item", ("t",), ("id",), page=2, size=2)
    assert [r.id for r in got.collect()] == [4, 6]


def test_labels_claims_columns_and_appends(spark):
    df = spark.sql("SELECT map('zh', 'z', 'en', '') labels, map('P94', array('', 'c.png'), 'P1', array('x')) claims, 'f' f")
    got = df.select(resolve.label_in(F.col("labels"), ("zh-hans", "zh"), F.col("f")), resolve.label_in(F.col("labels"), ("en",), F.col("f")), resolve.first_claim(F.col("claims"), ("P154", "P94"))).first()
    assert tuple(got) == ("z", "f", "c.png")
    assert rules.missing_columns(df, ("labels", "id")) == ["id"]
    old, new = spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string")
    once = resolve.append_new(old, new, "id")
    assert sorted(map(tuple, resolve.append_new(once, new, "id").collect())) == [(1, "a"), (2, "c")]


def test_long_groups_are_summed_over_several_ranges(spark, keep, request):
    rng = random.Random(6)
    rows = [(None if i % 7 == 0 else "hot" if i % 2 else f"u{i % 5}", i, rng.randrange(9)) for i in range(2_000)]
    dealt = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # few rows would become one task
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    got = analytics.running_sums(spark.createDataFrame(rows, "u string, o int, v int"), "u", "o", {"s": F.col("v")}, lambda df: dealt.append(keep(df)) or dealt[-1]).collect()
    n, s, size = {}, {}, {}
    for u, _, _ in rows:
        size[u] = size.get(u, 0) + 1
    want = []
    for u, o, v in rows:
        n[u], s[u] = n.get(u, 0) + 1, s.get(u, 0) + v
        want.append((u, o, v, n[u], size[u], s[u]))
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert dealt[0].where("u = 'hot'").select("__range").distinct().count() > 1


def test_first_of_a_group_are_picked_before_the_shuffle(spark):
    df = spark.range(3_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    got = analytics.top_k_by(df, "g", 5, F.col("v").desc())
    assert sorted((r.g, r.v, r["rank"]) for r in got.collect()) == sorted((g, 2999 - (1 - g) - 2 * k, k + 1) for g in (0, 1) for k in range(5))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan[plan.index("WindowGroupLimit") :] and plan.rindex("WindowGroupLimit") > plan.index("Exchange")
    many = analytics.top_k_by(df, "g", 1_200, F.col("v").desc(), parts=8)
    assert many.where("g = 0").count() == 1_200 and many.agg(F.min("v")).first()[0] == 2999 - 2 * 1_199 - 1


def test_lcg_shuffle_equals_the_generator_step_by_step(spark):
    rows = [(g, i * 3, len(g)) for g, n in (("a", 1), ("bb", 2), ("ccc", 57), ("", 9)) for i in range(n)]
    got: dict = {}
    for r in itembank.lcg_shuffle(spark.createDataFrame(rows, "g string, k int, s int"), "g", "k", F.col("s")).collect():
        got.setdefault(r.g, {})[r.place] = r.k
    for g, n in (("a", 1), ("bb", 2), ("ccc", 57), ("", 9)):
        assert [got[g][p] for p in range(1, n + 1)] == [3 * i for i in lcg(n, len(g))]
    start = time.perf_counter()
    big = itembank.lcg_shuffle(spark.range(100_000).withColumn("g", F.lit("x")), "g", "id", F.lit(7))
    assert big.agg(F.sum("place")).first()[0] == 100_000 * 100_001 // 2 and time.perf_counter() - start < 20


def test_near_copies_of_one_hash_are_classes(spark, keep):
    rng = random.Random(8)
    base = [rng.getrandbits(62) for _ in range(6)]
    rows = []
    for i in range(300):
        code = base[rng.randrange(6)]
        for _ in range(rng.choice([0, 0, 0, 1, 2, 3, 6])):
            code ^= 1 << rng.randrange(62)
        rows.append((i, None if i % 41 == 0 else [code], rng.randrange(50), rng.random() < 0.1))
    df = spark.createDataFrame(rows, "id int, code array<long>, o int, safe boolean")
    near = lambda a, b: a is not None and b is not None and (a[0] ^ b[0]).bit_count() <= 4
    kept, want = [], {}
    for i, code, _, safe in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = "kept" if safe or not any(near(code, k) for k in kept) else "dropped"
        if want[i] == "kept":
            kept.append(code)
    got = curate.near_copies(df, "id", "code", F.col("o"), F.col("safe"), keep, 4, 64)
    assert {r.id: r.state for r in got.collect()} == want
    first: dict = {}
    for i, code, *_ in rows:
        if code:
            first.setdefault(code[0], i)
    pairs = {(min(a, b), max(a, b)) for x, a in first.items() for y, b in first.items() if a != b and (x ^ y).bit_count() <= 4}
    for hot in (1_000, 1):
        assert {(r.a, r.b) for r in curate.banded_pairs(df, "id", "code", 4, 64, hot).collect()} == pairs


def test_many_copies_of_one_hash_give_no_pairs(spark, keep):
    df = spark.range(20_000).select("id", F.array(F.lit(5).cast("long"), F.lit(7).cast("long"), F.lit(0).cast("long"), F.lit(1).cast("long")).alias("code"))
    assert curate.banded_pairs(df, "id", "code").count() == 0
    assert curate.near_copies(df, "id", "code", F.col("id"), F.lit(False), keep).where("state = 'kept'").count() == 1
    assert curate.hash_classes(df, "id", "code").groupBy("class").count().first()["count"] == 20_000


def test_hot_keys_are_spread_and_unknown_keys_left_out(spark):
    e = spark.createDataFrame([(i, [f"k{i}", "hot"] if i < 4 else [f"k{i}", f"k{i}"]) for i in range(20)], "e int, keys array<string>")
    r = spark.createDataFrame([(i, ["hot", "x"] if i % 3 == 0 else [f"k{i % 25}", f"none{i}", None]) for i in range(600)], "r int, keys array<string>")
    want = {(a.e, b.r) for a in e.collect() for b in r.collect() if set(a.keys) & set(b.keys)}
    assert {tuple(x) for x in resolve.key_pairs(e, r, "e", "r").collect()} == want
    assert {x.r for x in resolve.with_a_key(r, e, "e", "r").collect()} == {b for _, b in want}
    a, b = resolve.listed_keys(e, r, "e", "r", "keys", "keys")
    assert b.where("k = 'hot'").select("salt").distinct().count() > 16 and a.where("k = 'hot'").count() == 4 * resolve.SALTS
    assert b.where("k like 'none%'").count() < 5
    assert resolve.key_pairs(e.limit(0), r, "e", "r").count() == 0 and resolve.key_pairs(e, r.limit(0), "e", "r").count() == 0


@pytest.mark.parametrize("crowded, cell", [(1_000_000, 20_000), (3, 4), (0, 1)])
def test_containment_of_keys_that_share_all_grams(spark, crowded, cell):
    rng = random.Random(9)
    keys = ["", None, "abc", "abcd", "abab", "ababab", "babababab", *("ab" * n for n in range(2, 12)), *("".join(rng.choice("ab") for _ in range(rng.randrange(3, 14))) for _ in range(60))]
    left = [(i, rng.choice(keys)) for i in range(70)]
    right = [(i, rng.choice(keys)) for i in range(70)]
    want = {(i, j) for i, x in left for j, y in right if x and y and (x == y or (len(x) >= 4 and x in y) or (len(y) >= 4 and y in x))}
    got = resolve.containment_pairs(spark.createDataFrame(left, "e int, key string"), spark.createDataFrame(right, "r int, key string"), "e", "r", 4, crowded, cell)
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)


def test_images_of_all_options_are_checked(spark):
    rows = [("brand_to_logo", "a", ["a", "b"]), ("brand_to_logo", "a", ["a", "bad"]), ("brand_to_logo", "a", ["a", None]), ("logo_to_brand", "a", ["a", "bad"]), ("logo_to_brand", "bad", ["a", "bad"])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, type string, answer string, options array<string>")
    checks = dict(itembank.item_checks(F.lit(True), F.lit("x"), itembank.item_images(lambda o: F.concat(F.lit("https://x/"), o, F.when(o == "bad", ".png").otherwise(".jpg"))), "https://x/"))
    assert {r.i: r.ok for r in df.select("i", checks["invalid_url"].alias("ok")).collect()} == {0: True, 1: False, 2: False, 3: True, 4: False}


def test_coverage_lists_all_that_are_missing(spark):
    entities = spark.createDataFrame([(i, "g" if i < 700 else "h") for i in range(704)], "e long, g string")
    candidates = spark.createDataFrame([(i, True) for i in range(700, 704)] + [(699, False)], "e long, ok boolean")
    got = {r.g: r for r in analytics.coverage(entities, candidates, "e", "g", F.col("ok")).collect()}
    assert got["g"].missing == list(range(699)) and (got["g"].missing_count, got["g"].covered, got["g"].approved) == (699, 1, 0)
    assert got["h"].missing == [] and (got["h"].missing_count, got["h"].ratio, got["h"].playable) == (0, 1.0, True)


def test_collection_report_lists_all_errors(spark):
    entities = spark.createDataFrame([(1,), (2,), (3,)], "e long")
    candidates = spark.createDataFrame([(1, f"error {i:03}") for i in range(450)] + [(2, None)], "e long, failed string")
    got = {r.e: tuple(r)[1:] for r in analytics.collection_report(entities, candidates, "e", F.col("failed")).collect()}
    assert got == {1: (450, 450, [f"error {i:03}" for i in range(450)]), 2: (1, 0, []), 3: (0, 0, [])}


def test_item_bank_broadcasts_no_table_that_grows(spark):
    entities = spark.createDataFrame([(i, f"g{i % 3}", f"c{i % 2}", f"name {i}") for i in range(40)], "e long, g string, c string, name string")
    items = itembank.item_bank(entities, "e", "g", "c")
    for df in (items, itembank.with_names(items, entities, "e", "name")):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert items.count() == 80 and items.where(F.size(F.array_distinct("options")) != 4).count() == 0


def test_matches_of_large_entities_are_ranked_in_ranges(spark):
    e = spark.createDataFrame([("e",), ("w",)], "entity_id string")
    r = spark.createDataFrame([(i, "e" if i % 10 else "w", i % 10 == 0 or i % 3 == 0, ("light", "default", "alt")[i % 3]) for i in range(500)], "record_id long, name string, wordmark boolean, variant string")
    found = resolve.rule_match(e, r, [("name", "high", F.col("entity_id"), F.col("name"))])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    ranked = resolve.rank_matches(found.join(r.drop("name"), "record_id"), kept)
    order = {k: sorted((x for x in r.collect() if x.name == k), key=lambda x: ({"default": 0, "light": 1}.get(x.variant, 10) + 100 * x.wordmark, x.record_id)) for k in "ew"}
    want = {(k, x.record_id): (n, k == "e" and n == 1, "" if k == "e" else "only_wordmark_candidate") for k, rows in order.items() for n, x in enumerate(rows, 1)}
    assert {(x.entity_id, x.record_id): (x["rank"], x.recommended, x.note) for x in ranked.collect()} == want
