"""Links and elements of web pages, by patterns over the page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogkit.functions import fixed, keys


def attribute(tag: Column, name: str) -> Column:
    """Value of a quoted attribute of a tag; blank without it."""
    return F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*["']([^"']*)["']""", 1)


def page_anchors(pages: DataFrame, page: str, url: str, html: str, most: int = 180) -> DataFrame:
    """Every anchor of every page: position, absolute URL, text, first keyword hit."""
    tags = pages.select(page, url, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)(<a\s[^>]*href=[^>]*>.*?</a>)"), 1)).alias("pos", "tag"))
    text = F.trim(F.regexp_replace(F.regexp_replace("tag", "<[^>]*>", ""), r"(?U)\s+", " "))
    out = tags.withColumn("href", attribute(F.col("tag"), "href")).withColumn("text", text)
    seen = F.lower(F.concat_ws(" ", "text", "href"))
    hit = F.get(F.filter(F.array(*map(F.lit, fixed.LINK_KEYWORDS)), lambda k: F.contains(seen, k)), F.lit(0))
    absolute = keys.absolute_url(F.col(url), F.col("href"))
    return out.select(
        page, "pos", absolute.alias("asset_url"), F.substring("text", 1, most).alias("link_text"), hit.alias("keyword"),
        keys.first_class(F.lower(F.concat_ws(" ", absolute, "text")), fixed.LINK_CLASSES, "unknown").alias("asset_type"),
        F.when(hit.contains("brand") | hit.contains("logo"), "medium").when(hit.isNotNull(), "low").alias("confidence"),
    )


def icon_links(pages: DataFrame, page: str, url: str, html: str) -> DataFrame:
    """Declared icons of every page: kind, absolute URL, largest side, priority."""
    tags = pages.select(page, url, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)(<(?:link|meta)\s[^>]*>)"), 1)).alias("pos", "tag"))
    rel = F.lower(attribute(F.col("tag"), "rel"))
    social = F.lower(attribute(F.col("tag"), "property")).isin("og:image") | F.lower(attribute(F.col("tag"), "name")).isin("og:image")
    kind = F.when(rel.contains("manifest"), "manifest-link").when(rel.contains("apple-touch-icon"), "apple-touch-icon").when(rel.contains("mask-icon"), "mask-icon").when(rel.contains("icon"), "icon").when(social, "og:image")
    target = F.when(kind == "og:image", attribute(F.col("tag"), "content")).otherwise(attribute(F.col("tag"), "href"))
    size = F.when(kind.isin("icon", "apple-touch-icon"), keys.largest_side(attribute(F.col("tag"), "sizes"))).otherwise(0)
    found = tags.select(page, "pos", kind.alias("kind"), keys.absolute_url(F.col(url), target).alias("icon_url"), size.alias("size"))
    return found.where("kind is not null and icon_url <> ''").withColumn("priority", icon_priority(F.col("kind"), F.col("size")))


def icon_priority(kind: Column, size: Column) -> Column:
    large = (kind == "manifest") & (size >= 512)
    return F.when(large, fixed.LARGE_MANIFEST_PRIORITY).when(kind == "manifest", fixed.MANIFEST_PRIORITY).otherwise(keys.mapped(kind, fixed.ICON_PRIORITY, fixed.OTHER_ICON_PRIORITY))


def manifest_icons(manifests: DataFrame, page: str, url: str, icons: str = "icons") -> DataFrame:
    """Icons listed in landed manifest documents."""
    one = manifests.select(page, url, F.posexplode(icons).alias("pos", "icon"))
    size = keys.largest_side(F.col("icon.sizes"))
    return one.select(page, "pos", F.lit("manifest").alias("kind"), keys.absolute_url(F.col(url), F.col("icon.src")).alias("icon_url"), size.alias("size"), icon_priority(F.lit("manifest"), size).alias("priority"))


def element_score(text: Column, domain: Column, width: Column, height: Column, kind: Column) -> Column:
    """Keyword weights in an element's text, the domain's weight and a bonus for its size."""
    low = F.lower(F.coalesce(text, F.lit("")))
    score = F.when(F.contains(low, domain), fixed.DOMAIN_WEIGHT).otherwise(0)
    for word, weight in fixed.ELEMENT_WEIGHTS:
        score = score + F.when(low.contains(word), weight).otherwise(0)
    return score + F.least(width + height, F.when(kind == "svg", 80).otherwise(120))


def first_per_url(links: DataFrame, page: str) -> DataFrame:
    """The first link to each URL of a page."""
    return links.groupBy(page, "icon_url").agg(F.min_by(F.struct("kind", "size", "priority"), "pos").alias("r"), F.min("pos").alias("pos")).select(page, "icon_url", "pos", "r.*")


def fetch_status(status: Column, location: Column, size: Column, content_type: Column, failed: Column) -> Column:
    """What a landed response means for the asset that was asked for."""
    return (
        F.when(failed, "error").when((status >= 300) & (status < 400), F.when(F.contains(F.coalesce(location, F.lit("")), F.lit("hotlinking")), "hotlink_blocked").otherwise("redirected"))
        .when(status == 404, "not_found").when((status < 200) | (status >= 300) | (F.coalesce(size, F.lit(0)) == 0), "download_failed")
        .when(~F.coalesce(F.lower(content_type).startswith("image/"), F.lit(False)), "not_image_response").otherwise("converted")
    )
