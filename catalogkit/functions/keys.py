"""Column -> Column functions for names, domains, URLs, paths and match keys.

Blank strings count as missing everywhere, as in the source catalogs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogkit.functions import fixed

CJK = "一-鿿"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def first_of(*columns: Column) -> Column:
    """The first value that is neither null nor empty; each expression is there once."""
    return F.get(F.filter(F.array(*columns), lambda x: x != ""), F.lit(0))


def norm_key(c: Column, keep_cjk: bool = True) -> Column:
    """Lower-case letters and digits only (and CJK ideographs, if kept)."""
    return F.regexp_replace(F.lower(_text(c)), f"[^a-z0-9{CJK if keep_cjk else ''}]+", "")


def slug(c: Column, most: int = 80, default: str = "item", ampersand: bool = False) -> Column:
    """Words joined by single underscores, cut at ``most`` characters."""
    low = F.lower(_text(c))
    low = F.replace(low, F.lit("&"), F.lit("and")) if ampersand else low
    cut = F.substring(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, most)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(default))


def composite_id(source: Column, entity: Column, suffix: Column) -> Column:
    return F.concat_ws("_", source, entity, slug(suffix))


def host(c: Column) -> Column:
    """Host of a URL or bare domain: lower-case, without ``www.``, port and path."""
    bare = F.regexp_replace(F.trim(_text(c)), "^(?i)https?://", "")
    bare = F.regexp_replace(F.regexp_extract(bare, r"^([^/?#]*)", 1), r"^[^@]*@|:\d+$", "")
    return F.regexp_replace(F.lower(bare), r"^www\.", "")


def url_for(template: str, value: Column) -> Column:
    """The template with its ``%s`` filled by a host."""
    return F.format_string(template, host(value))


def masked(url: Column) -> Column:
    """The URL with the values of its query masked."""
    return F.regexp_replace(url, "=[^&#]*", "=***")


def absolute_url(base: Column, value: Column) -> Column:
    """``value`` seen from the page ``base``; blank for a blank value."""
    scheme = F.regexp_extract(base, r"^(https?:)", 1)
    root = F.regexp_extract(base, r"^(https?://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^https?://[^/?#]*([^?#]*)", 1), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(_text(value) == "", "").when(value.rlike("^(?i)https?://"), value).when(value.startswith("//"), F.concat(scheme, value))
        .when(value.startswith("/"), F.concat(root, value)).when(value.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), value)).otherwise(F.concat(root, folder, value))
    )


def media_format(url: Column, content_type: Column) -> Column:
    """Format by content type, else by the URL's extension, else ``bin``."""
    t = F.lower(_text(content_type))
    by_type = F.when(t.contains("svg"), "svg").when(t.contains("png"), "png").when(t.contains("jpeg") | t.contains("jpg"), "jpg").when(t.contains("webp"), "webp").when(t.contains("icon"), "ico")
    return F.coalesce(by_type, F.nullif(extension(F.split_part(_text(url), F.lit("?"), F.lit(1))), F.lit("")), F.lit("bin"))


def largest_side(c: Column) -> Column:
    """The larger of the sides in the first ``WxH``; 0 without one."""
    side = [F.coalesce(F.nullif(F.regexp_extract(_text(c), r"(\d+)x(\d+)", k), F.lit("")).cast("int"), F.lit(0)) for k in (1, 2)]
    return F.greatest(*side)


def clean_path(c: Column) -> Column:
    return F.lower(F.replace(_text(c), F.lit("\\"), F.lit("/")))


def basename(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(_text(c), "/+$", ""), "/"), -1)


def extension(c: Column) -> Column:
    """Lower-case extension of the last path part, without the dot."""
    return F.lower(F.regexp_extract(basename(c), r"[^.]\.([^.]*)$", 1))


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"(?<=[^.])\.[^.]*$", "")


def capitalised(c: Column) -> Column:
    """Upper-case the first letter of every run of ASCII word characters, and nothing else."""
    runs = F.regexp_extract_all(c, F.lit("([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[a-z]"), F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30))).otherwise(r)), "")


def clean_name(c: Column) -> Column:
    """Display name: without file and role suffix, spaced, capitalised; CJK names stay."""
    raw = F.trim(_text(c))
    short = F.regexp_replace(F.regexp_replace(raw, fixed.IMAGE_SUFFIX, ""), fixed.NAME_SUFFIX, "")
    short = F.trim(F.regexp_replace(F.regexp_replace(short, "[-_]+", " "), r"(?U)\s+", " "))
    return F.when(raw.rlike(f"[{CJK}]"), raw).otherwise(capitalised(short))


def prompt_name(c: Column) -> Column:
    return F.when(c.rlike(f"[{CJK}]"), c).otherwise(F.concat(F.lit(" "), c, F.lit(" ")))


def note_token(c: Column) -> Column:
    return F.trim(F.split_part(_text(c), F.lit(";"), F.lit(1)))


def spaced(c: Column) -> Column:
    """Words of a name: without image suffix, separators as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(_text(c), fixed.IMAGE_SUFFIX, ""), "[-_]+", " "), r"(?U)\s+", " "))


def unglued(c: Column) -> Column:
    """A known suffix word split off the end of a name."""
    return F.trim(F.regexp_replace(F.regexp_replace(spaced(c), f"(?i)({'|'.join(fixed.GLUED_SUFFIXES)})$", " $1"), r"(?U)\s+", " "))


def query_forms(entity: Column, name: Column, display: Column, most: int = 4) -> Column:
    """Search queries for an entity: derived forms, blank ones out, first seen first."""
    known = first_filled(display, name, entity)
    forms = [display, name, F.concat(known, F.lit(" brand")), F.concat(known, F.lit(" company")), unglued(known), entity, unglued(entity), F.regexp_replace(_text(entity), "([a-z])([A-Z])", "$1 $2")]
    return F.slice(F.array_distinct(F.filter(F.array(*map(spaced, forms)), lambda x: x != "")), 1, most)


def _keys(values: list[Column]) -> Column:
    return F.array_distinct(F.filter(F.array(*map(norm_key, values)), lambda k: F.length(k) > 1))


def entity_keys(entity: Column, *names: Column, domain: Column) -> Column:
    """Match keys of an entity: its id, names, domain and the domain's first label."""
    return _keys([entity, *names, domain, F.split_part(_text(domain), F.lit("."), F.lit(1))])


def without_role(c: Column, roles: str = "icon|default|color|logo") -> Column:
    return F.regexp_replace(c, f"(?i)[-_ ]?({roles})$", "")


def record_keys(record: Column, title: Column, path: Column, legacy: Column) -> Column:
    """Match keys of a record: title, id, every path part with and without its role
    suffix, and the legacy id with and without its prefix."""
    parts = F.transform(F.split(clean_path(path), "/"), lambda p: F.regexp_replace(p, fixed.IMAGE_SUFFIX, ""))
    named = F.array(title, record, legacy, F.regexp_replace(_text(legacy), "^[^_]+_", ""))
    every = F.concat(named, parts, F.transform(parts, lambda p: without_role(p)))
    return F.array_distinct(F.filter(F.transform(every, lambda x: norm_key(x)), lambda k: F.length(k) > 1))


def canonical_key(source: Column, path: Column, legacy: Column) -> Column:
    """Key by which copies of one logo meet; null if nothing but other scripts is left."""
    raw = clean_path(path)
    folder = {"thesvg": r"public/icons/([^/]+)/", "vectorlogozone": r"logos/([^/]+)/", "wikimedia": r"assets/_raw/wikimedia/([^/]+)/"}
    key = F.when(_text(legacy) != "", F.regexp_replace(legacy, "^[^_]+_", ""))
    for name, pattern in folder.items():
        key = key.when(source == name, F.regexp_extract(raw, pattern, 1))
    key = norm_key(without_role(key.otherwise(stem(raw)), "icon|default|color"), keep_cjk=False)
    return F.nullif(F.when(key.isin("amazonaws", "amazonwebservices"), "aws").otherwise(key), F.lit(""))


def entity_from_path(path: Column) -> Column:
    """Folder or file name that names the entity in a known layout; null otherwise."""
    raw = clean_path(path)
    layouts = (
        r"assets/_raw/(?:expanded-wikimedia|expanded-website-icons|wikimedia)/([^/]+)/", r"vendor/vectorlogozone/www/logos/([^/]+)/", r"^([^/]+)/[^/]+-(?:icon|ar21)\.svg",
        r"public/icons/([^/]+)/", r"(?:logos/optimized|local-logos)/([^/]+)\.(?:svg|png|webp|jpe?g)$",
    )
    found = F.transform(F.array(*map(F.lit, layouts)), lambda p: F.call_function("regexp_extract", raw, p, F.lit(1)))
    single = without_role(F.regexp_extract(raw, r"vendor/gilbarbara-logos/logos/([^/]+)\.svg$", 1), "icon|logo|symbol|mark|default|color")
    return F.get(F.filter(F.concat(found, F.array(single)), lambda x: x != ""), F.lit(0))


def is_generic_id(c: Column) -> Column:
    return F.lower(_text(c)).isin(*fixed.GENERIC_IDS)


def entity_id(override: Column, source: Column, legacy: Column, path: Column, notes: Column) -> Column:
    """Override, else the legacy id less its category, else a known layout of the path or
    notes, else the first note token, else the legacy id, else the file's name."""
    token = note_token(notes)
    prefix = F.concat(token, F.lit("_"))
    own = F.when((token != "") & legacy.startswith(prefix), F.substr(legacy, F.length(prefix) + 1)).otherwise(legacy)
    named = F.array(F.when(source == "svglogo", own), entity_from_path(path), entity_from_path(notes), F.when(token.rlike("^[a-z0-9_]+$") & ~token.isin("meta", "orphan"), token), F.regexp_replace(legacy, "^[^_]+_", ""), without_role(stem(clean_path(path))))
    slugs = F.transform(named, lambda x, i: F.struct(slug(x, default="", ampersand=True).alias("id"), i.alias("i")))
    # a generic word from a layout does not count
    fit = F.filter(slugs, lambda x: (x["id"] != "") & ~(x["i"].isin(1, 2) & is_generic_id(x["id"])))
    return first_of(override, F.get(F.transform(fit, lambda x: x["id"]), F.lit(0)), F.lit("brand"))


def mapped(c: Column, table: dict, default) -> Column:
    """Lookup in a small fixed table."""
    out = F
    for key, value in table.items():
        out = out.when(c == key, F.lit(value))
    return out.otherwise(F.lit(default))


def category_by_words(c: Column) -> Column:
    low, out = F.lower(_text(c)), None
    for listed, name in fixed.KEYWORD_CATEGORIES:
        hit = low.rlike(rf"\b({'|'.join(listed)})\b")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("")


def first_class(c: Column, classes: tuple, default: str) -> Column:
    out = F
    for needle, name in classes:
        out = out.when(c.contains(needle), name)
    return out.otherwise(default)


def half_up(c: Column) -> Column:
    """Round half toward plus infinity."""
    return F.floor(c + 0.5)


def two_places(c: Column) -> Column:
    """A double with two decimals as C's printf gives it: its exact value is rounded, ties to the even digit (``format_string``
    rounds its shortest decimal form, ties up). Null stays null. From 9e16 on, zeros stand after the digits of the shortest form."""
    c = c.cast("double")
    a = F.abs(c)
    p, high = a * 100.0, a * 134217729.0 - (a * 134217729.0 - a)
    rest = (high * 100.0 - p) + (a - high) * 100.0  # a * 100 is exactly p + rest
    whole = F.floor(p)
    over = p - whole.cast("double") - 0.5
    up = (over > 0) | ((over == 0) & ((rest > 0) | ((rest == 0) & (whole % 2 == 1))))
    cents = whole + F.when(p < float(1 << 53), up.cast("long")).otherwise(F.rint(rest).cast("long"))
    sign = F.when(c.cast("string").startswith("-"), "-").otherwise("")
    text = F.concat(sign, F.call_function("div", cents, F.lit(100)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when(F.isnan(c), "nan").when(a == float("inf"), F.concat(sign, F.lit("inf"))).when(a < 9e16, text).otherwise(F.when(c.isNotNull(), F.format_string("%.2f", c)))


def megabytes(c: Column) -> Column:
    return F.concat(two_places(c / (1024.0 * 1024.0)), F.lit(" MB"))


def seconds(c: Column, units: float = 1000.0) -> Column:
    """A time of which ``units`` are a second, milliseconds by default."""
    return F.concat(two_places(c / units), F.lit("s"))


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def json_script_escaped(c: Column) -> Column:
    """JSON text that may stand inside a script element."""
    for a, b in (("<", "\\u003c"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def type_label(kind: Column) -> Column:
    return mapped(kind, fixed.TYPE_LABELS, fixed.TYPE_LABELS["logo_to_brand"])


def file_score(source: Column, name: Column) -> Column:
    """Quality of a collected file by its source and its name."""
    out = F
    for known, (word, with_word, without) in fixed.FILE_SCORES.items():
        out = out.when(source == known, F.when(F.lower(name).contains(word), with_word).otherwise(without) if word else F.lit(without))
    return out.otherwise(fixed.OTHER_FILE_SCORE)


def banded(c: Column, bands: tuple, default: str) -> Column:
    out = F
    for least, name in bands:
        out = out.when(c >= least, name)
    return out.otherwise(default)


def aspect_ratio(svg: Column) -> Column:
    """Width by height of SVG text: its view box, else its width and height, else 0."""
    box = [F.regexp_extract(svg, r"""viewBox=["']\s*[-\d.]+[\s,]+[-\d.]+[\s,]+([\d.]+)[\s,]+([\d.]+)""", k) for k in (1, 2)]
    size = [F.regexp_extract(svg, rf"""\s{x}=["']([\d.]+)""", 1) for x in ("width", "height")]
    number = [[F.nullif(x, F.lit("")).cast("double") for x in pair] for pair in (box, size)]
    return F.coalesce(*(F.try_divide(w, h) for w, h in number), F.lit(0.0))


def looks_generated(entity: Column, name: Column, display: Column) -> Column:
    """Names that look made by a machine: blank, the id itself, or one long capitalised word."""
    shown = F.trim(F.coalesce(F.nullif(display, F.lit("")), F.nullif(name, F.lit("")), F.lit("")))
    compact, own = norm_key(shown), norm_key(entity)
    return F.when(shown == "", True).when(shown.rlike(f"[{CJK}]"), False).otherwise(((compact == own) & (F.length(own) >= 7)) | (shown.rlike("^[A-Z][a-z0-9]+$") & (F.length(shown) >= 9)))
