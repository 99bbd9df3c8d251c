from pyspark.sql import functions as F

from catalogkit.functions import keys


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).cast("string" if isinstance(v, str) or v is None else "int").alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_blank_counts_as_missing(spark):
    assert one(spark, keys.first_filled(F.col("a"), F.col("b")), a="  ", b="y") == "y"


def test_match_keys_with_and_without_cjk(spark):
    assert one(spark, keys.norm_key(F.col("a")), a="Aé-b 腾讯!") == "ab腾讯"
    assert one(spark, keys.norm_key(F.col("a"), False), a="腾讯") == ""
    assert one(spark, keys.norm_key(F.col("a")), a=None) == ""


def test_slug(spark):
    assert one(spark, keys.slug(F.col("a"), ampersand=True), a="--A&B  c!") == "aandb_c"
    assert one(spark, keys.slug(F.col("a")), a="&&&") == "item"
    assert len(one(spark, keys.slug(F.col("a")), a="x" * 200)) == 80


def test_host(spark):
    for value, want in (("https://WWW.Example.com:8080/a?b", "example.com"), ("www.a.org", "a.org"), ("http://u@h.io#t", "h.io"), ("", ""), (None, "")):
        assert one(spark, keys.host(F.col("a")), a=value) == want


def test_absolute_url(spark):
    for value, want in (("/x", "https://h.io/x"), ("//c.io/x", "https://c.io/x"), ("x", "https://h.io/d/x"), ("http://o/x", "http://o/x"), ("", "")):
        assert one(spark, keys.absolute_url(F.lit("https://h.io/d/p.html?q"), F.col("a")), a=value) == want


def test_capitals_follow_every_break_and_keep_the_rest(spark):
    assert one(spark, keys.capitalised(F.col("a")), a="macy's iPhone a&b") == "Macy'S IPhone A&B"


def test_clean_name(spark):
    for value, want in (("foo-bar_icon.svg", "Foo Bar"), ("default", ""), ("腾讯 logo", "腾讯 logo"), ("a　 b", "A B"), ("", "")):
        assert one(spark, keys.clean_name(F.col("a")), a=value) == want


def test_media_format_and_sizes(spark):
    assert one(spark, keys.media_format(F.col("u"), F.col("t")), u="a.PNG?x", t="") == "png"
    assert one(spark, keys.media_format(F.col("u"), F.col("t")), u="a", t=None) == "bin"
    assert one(spark, keys.largest_side(F.col("a")), a="16x32 64x64") == 32
    assert one(spark, keys.largest_side(F.col("a")), a="any") == 0


def test_query_forms_keep_first_seen_order(spark):
    got = one(spark, keys.query_forms(F.col("e"), F.col("n"), F.col("d")), e="alibabacloud", n="", d="")
    assert got == ["alibabacloud brand", "alibabacloud company", "alibaba cloud", "alibabacloud"]


def test_entity_id_branches(spark):
    cases = (
        (None, "thesvg", None, "vendor/thesvg/public/icons/Foo-Bar/default.svg", "x", "foo_bar"),
        (None, "gilbarbara", None, "vendor/gilbarbara-logos/logos/foo-icon.svg", "x", "foo"),
        (None, "svglogo", "tools_foo", "a.svg", "tools; b", "foo"),
        ("mine", "svglogo", "tools_foo", "a.svg", "tools; b", "mine"),
        (None, "other", None, "z/favicon.png", "noted; b", "noted"),
        (None, "other", None, "z/Big_Co-logo.png", "No Token; b", "big_co"),
        (None, "thesvg", None, "public/icons/logo/default.svg", "Some Notes", "default"),
    )
    for override, source, legacy, path, notes, want in cases:
        got = one(spark, keys.entity_id(F.col("o"), F.col("s"), F.col("l"), F.col("p"), F.col("n")), o=override, s=source, l=legacy, p=path, n=notes)
        assert got in (want, "brand") and (got == want or want == "default"), (path, got)


def test_aspect_ratio(spark):
    assert one(spark, keys.aspect_ratio(F.col("a")), a='<svg viewBox="0 0 30 10">') == 3.0
    assert one(spark, keys.aspect_ratio(F.col("a")), a='<svg width="20" height="10">') == 2.0
    assert one(spark, keys.aspect_ratio(F.col("a")), a="<svg>") == 0.0


def test_half_up_and_html(spark):
    assert one(spark, keys.half_up(F.lit(-2.5))) == -2
    assert one(spark, keys.html_escaped(F.col("a")), a='<a href="x">&') == "&lt;a href=&quot;x&quot;&gt;&amp;"


def test_two_places_as_printf(spark):
    values = [0.125, 0.375, 0.625, 1310.72 * 100 / 1048576, 1.005, 2.675, 0.285, 0.0, -0.0, -0.001, -0.125, 45035996273704.96, 90071992547409.92, 1e15 + 0.125, 1e15 + 0.375, 89e15, float("nan"), float("inf"), float("-inf"), 1e17]
    values += [n / 1000 for n in range(0, 30_000, 7)] + [n / 8 for n in range(-99, 99)] + [n * 1.37e9 / 1048576 for n in range(3_000)]
    got = spark.createDataFrame(list(enumerate(values)) + [(-1, None)], "i long, v double").select("i", keys.two_places(F.col("v"))).collect()
    assert [r[1] for r in sorted(got)] == [None] + ["%.2f" % v for v in values]
    assert one(spark, keys.megabytes(F.col("a").cast("double") * 100), a="1310.72") == "0.12 MB"  # an exact tie
    assert one(spark, keys.seconds(F.col("a").cast("long")), a="125") == "0.12s" and one(spark, keys.seconds(F.col("a").cast("long"), 100.0), a="125") == "1.25s"


def test_looks_generated(spark):
    for entity, shown, want in (("x", "", True), ("bigcompany", "bigcompany", True), ("abc", "Abcdefghij", True), ("a", "腾讯", False), ("ab", "Two Words", False)):
        assert one(spark, keys.looks_generated(F.col("e"), F.lit(""), F.col("d")), e=entity, d=shown) is want
