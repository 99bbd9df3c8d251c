"""Ordered rule tables compiled to one expression, and declarative checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogkit.functions import fixed, keys


def first_rule(rules: list[tuple[str | None, Column]]) -> Column:
    """The name of the first rule that holds; a rule named None lets the row pass."""
    out = F
    for name, condition in rules:
        out = out.when(F.coalesce(condition, F.lit(False)), F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


def failed_rules(rules: list[tuple[str, Column]]) -> Column:
    """Names of all rules that a row breaks, in order."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules)), lambda x: x.isNotNull())


def is_wordmark(path: Column, ratio: Column | None = None) -> Column:
    named = F.lower(keys.basename(path)).rlike(fixed.WORDMARK_NAME)
    return named if ratio is None else named | (ratio >= fixed.WORDMARK_RATIO)


def is_service_icon(source: Column, path: Column) -> Column:
    raw = keys.clean_path(path)
    return reduce(Column.__or__, ((source == name) & raw.rlike(pattern) for name, pattern in fixed.SERVICE_ICONS.items()))


def is_protected(source: Column, wordmark: Column) -> Column:
    return (source == "svglogo") & ~F.coalesce(wordmark, F.lit(False))


def exclusion_rules(source: Column, path: Column, title: Column, wordmark: Column, allowed: Column) -> list[tuple[str | None, Column]]:
    """The curation chain, in the order in which its reasons are given."""
    raw = keys.clean_path(path)
    return [
        ("wordmark_or_visible_answer", wordmark),
        (None, is_protected(source, wordmark)),
        ("aws_service_icon", is_service_icon(source, path)),
        ("not_popular_quiz_brand", ~F.coalesce(allowed, F.lit(False))),
        ("website_declared_icon_source", source == "website-icons"),
        ("site_internal_icon", raw.rlike(fixed.SITE_ICON)),
        ("tool_extension_icon", raw.contains(fixed.EXTENSION_FOLDER)),
        ("site_internal_icon", raw.rlike(fixed.PUBLIC_ICON)),
        *((reason, (source == name) & ~raw.rlike(pattern)) for name, (pattern, reason) in fixed.PRIMARY_VARIANTS.items()),
        ("generic_size_icon", raw.rlike(fixed.SIZE_ICON) | F.lower(title).rlike(fixed.SIZE_TITLE)),
    ]


def allowed_ids(records: DataFrame, aliases: DataFrame, record: str = "record_id", title: str = "title", path: str = "path", ident: Column | None = None, legacy: str | None = None, recommended: DataFrame | None = None) -> DataFrame:
    """Identifiers of records on the allow-list: the title or a path part equals an alias
    (or an alias with a role word), or ``ident`` (the identifier, if not given) holds an alias of 4
    letters or more, or the ``legacy`` identifier is among the ``id`` of ``recommended``.

    Exact parts meet in an equi join; containment meets aliases by their n-grams of 4."""
    named = aliases.select(F.col("alias")).where(F.length("alias") > 0).distinct()
    parts = F.transform(F.split(keys.clean_path(F.col(path)), "/"), lambda p: keys.norm_key(F.regexp_replace(p, fixed.IMAGE_SUFFIX, ""), keep_cjk=False))
    bare = F.flatten(F.transform(parts, lambda p: F.array(p, F.regexp_replace(p, "(icon|default|color)$", ""))))
    exact = records.select(record, F.explode(F.array_distinct(F.concat(F.array(keys.norm_key(F.col(title), keep_cjk=False)), bare))).alias("alias")).join(named, "alias", "left_semi").select(record)
    own = keys.norm_key((F.col(record) if ident is None else ident).cast("string"), keep_cjk=False)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("ident") - 3, F.lit(1))), lambda i: F.substr(F.col("ident"), i, F.lit(4)))
    probed = records.select(record, own.alias("ident")).select(record, "ident", F.explode(F.array_distinct(grams)).alias("gram"))
    found = exact.unionByName(probed.join(named.where(F.length("alias") >= 4).withColumn("gram", F.substring("alias", 1, 4)), "gram").where(F.contains("ident", "alias")).select(record))
    if legacy and recommended is not None:
        found = found.unionByName(records.join(recommended.select(F.col("id").alias("__legacy")), F.col(legacy) == F.col("__legacy"), "left_semi").select(record))
    return found.distinct()


def capped_errors(errors: DataFrame, order: tuple[str, ...], most: int = fixed.ERROR_SAMPLES) -> DataFrame:
    """One row: ``error_count`` (all of them), ``valid``, and ``errors``, the first ``most`` in order."""
    total = errors.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(None).cast(f"array<{errors.schema.simpleString()}>").alias("errors"))
    sample = errors.orderBy(*order).limit(most).agg(F.array_sort(F.collect_list(F.struct(*errors.columns))).alias("errors")).select(F.lit(0).cast("long").alias("n"), "errors")
    both = total.unionByName(sample).agg(F.max("n").alias("error_count"), F.first("errors", ignorenulls=True).alias("errors"))
    return both.select("error_count", (F.col("error_count") == 0).alias("valid"), "errors")


def faceted(df: DataFrame, facets: dict[str, object], words: str = "", over: tuple[str, ...] = (), order: tuple[str, ...] = (), page: int = 1, size: int = 120) -> DataFrame:
    """Rows that match all given facets and contain the words in the joined fields, one page."""
    for name, value in facets.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    if words:
        df = df.where(F.contains(F.lower(F.concat_ws(" ", *over)), F.lit(words.lower())))
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    """Required columns that a table lacks; looks at its schema only."""
    return [c for c in required if c not in df.columns]


def column_report(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """One row for each required column: whether the table has it, its rows, and how many of them leave it blank (all, if it
    is missing). One pass over the table."""
    blank = lambda c: F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "") if c in df.columns else F.count(F.lit(1))
    counted = df.agg(F.count(F.lit(1)).alias("__n"), *(blank(c).alias(f"__{i}") for i, c in enumerate(required)))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(c in df.columns).alias("present"), F.col("__n").alias("n"), F.col(f"__{i}").alias("blank")) for i, c in enumerate(required)))
    return counted.select(F.inline(rows))
