"""Payloads of engines as result rows, in column expressions.

A payload table has one row per answer, its text in a column; each decoder
gives one row per item, with ``position`` from 1. Texts that can't be parsed
give no items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys under which lists of items stand, and names of fields.
LISTS = ["results", "items", "value", "works", "search", "data", "organic", "webPages", "hits", "documents", "entries"]
FIELDS = {"title": ["title", "name", "heading", "Title"], "url": ["url", "URL", "html_url", "link", "href"], "snippet": ["snippet", "summary", "content", "description", "abstract"]}
# The longest title and snippet that are kept.
TITLE, SNIPPET = 200, 300


def json_items(payload: Column, path: str | None = None) -> Column:
    """The items of a JSON payload as an array of JSON texts: at a dotted
    path, else the first list of objects under a known key, at most three
    levels down. One object in place of a list is one item."""
    items = lambda p: F.from_json(F.get_json_object(payload, p), "array<string>")
    if path is not None:
        at = "$" if path in ("", ".", "$", "[]") else "$." + path
        found = F.get_json_object(payload, at)
        return F.when(found.startswith("["), items(at)).when(found.startswith("{"), F.array(found)).otherwise(F.array().cast("array<string>"))
    places = ["$", *[f"$.{a}" for a in LISTS], *[f"$.{a}.{b}" for a in ("data", "webPages", "search", "results") for b in LISTS if a != b], *[f"$.data.{a}.{b}" for a in ("webPages", "search") for b in ("value", "results", "items")]]
    is_list = lambda p: F.get_json_object(payload, p).rlike(r"^\s*\[\s*\{")
    return F.coalesce(*[F.when(is_list(p), items(p)) for p in places], F.array().cast("array<string>"))


def json_field(item: Column, names: list[str]) -> Column:
    """The first field of the names that is not empty, of a variant; of a list
    its first entry; an object counts as empty. Dotted names go down."""

    def plain(path: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(item, path, "variant"))
        value = F.trim(F.try_variant_get(item, path, "string"))
        return F.when(~kind.rlike("^(?:OBJECT|ARRAY)") & (value != ""), value)

    return F.coalesce(*[x for n in names for x in (plain(f"$.{n}"), plain(f"$.{n}[0]"))])


def decode_json(payloads: DataFrame, payload: str = "payload", path: str | None = None, fields: dict[str, list[str]] | None = None, url_template: str | None = None, most: int | None = None) -> DataFrame:
    """Items of JSON payloads: the columns of the table, ``position, title,
    url, snippet``. Items with neither title nor URL are left out.

    ``url_template`` builds a URL from ``{dotted.fields}`` where the item has
    none; URLs without a scheme get https. ``most`` keeps the first items.
    """
    names = FIELDS | (fields or {})
    items = json_items(F.col(payload), path)
    rows = payloads.select("*", F.posexplode(items if most is None else F.slice(items, 1, most)).alias("_at", "_text"))
    rows = rows.withColumn("_item", F.try_parse_json("_text"))
    url = json_field(F.col("_item"), names["url"])
    if url_template is not None:
        parts = [F.lit(p) if i % 2 == 0 else F.coalesce(json_field(F.col("_item"), [p]), F.lit("")) for i, p in enumerate(_template(url_template))]
        url = F.when(F.coalesce(url, F.lit("")).rlike("^https?://"), url).otherwise(F.concat(*parts))
    url = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    out = rows.select(*payloads.columns, (F.col("_at") + 1).alias("position"), F.substring(json_field(F.col("_item"), names["title"]), 1, TITLE).alias("title"), url.alias("url"), F.substring(json_field(F.col("_item"), names["snippet"]), 1, SNIPPET).alias("snippet"))
    return out.filter("title is not null or url is not null")


def _template(template: str) -> list[str]:
    """Texts and field names in turn."""
    out, rest = [], template
    while "{" in rest:
        text, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [text, name]
    return [*out, rest]


def decode_feed(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Items of RSS and Atom feeds: the columns of the table, ``position,
    title, url, snippet``; items without a title are left out."""
    xml = F.regexp_replace(F.coalesce(F.col(payload), F.lit("")), r"\sxmlns(?::\w+)?=(?:\"[^\"]*\"|'[^']*')", "")
    sound = F.when(xml.rlike(r"(?s)<(rss|feed|rdf)\b.*</\1>|(?s)<\w+:RDF\b.*</\w+:RDF>"), xml)
    entries = F.when(sound.rlike(r"<entry\b"), F.regexp_extract_all(sound, F.lit(r"(?s)<entry\b[^>]*>.*?</entry>"), F.lit(0))).otherwise(F.regexp_extract_all(sound, F.lit(r"(?s)<item\b[^>]*>.*?</item>"), F.lit(0)))
    rows = payloads.select("*", F.posexplode(entries).alias("_at", "_e"))

    def inner(*names: str) -> Column:
        found = F.coalesce(*[F.when(x != "", x) for x in (F.regexp_extract("_e", rf"(?s)<{n}\b[^>]*>(.*?)</{n}>", 1) for n in names)])
        plain = F.regexp_replace(found, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
        return F.trim(F.regexp_replace(unescaped(plain), r"\s+", " "))

    href = F.regexp_extract("_e", r"<link\b[^>]*?title=\"pdf\"[^>]*?href=\"([^\"]*)\"", 1)
    other = F.regexp_extract("_e", r"<link\b[^>]*?href=\"([^\"]*)\"", 1)
    link = F.coalesce(F.when(href != "", unescaped(href)), inner("link"), inner("id"), F.when(other != "", unescaped(other)), inner("guid"))
    out = rows.select(*payloads.columns, (F.col("_at") + 1).alias("position"), F.substring(inner("title"), 1, TITLE).alias("title"), link.alias("url"), F.substring(inner("summary", "description", "content"), 1, SNIPPET).alias("snippet"))
    return out.filter("title <> ''")


def unescaped(value: Column) -> Column:
    """Text without the five escapes of XML."""
    for escape, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        value = F.replace(value, F.lit(escape), F.lit(char))
    return value


def escaped(value: Column) -> Column:
    """Text with the escapes that XML asks for."""
    for char, escape in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(char), F.lit(escape))
    return value


def page_text(html: Column) -> Column:
    """The blocks of a page over twenty characters, without scripts, styles,
    navigation, headers and footers, parted by blank lines."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|nav|header|footer|aside|noscript|iframe)\b[^>]*>.*?</\1>|<!--.*?-->|<title\b[^>]*>.*?</title>", " ")
    blocks = F.split(body, r"(?i)</(?:p|div|article|section|li|h[1-4]|td|blockquote)\s*>")
    plain = F.transform(blocks, lambda b: F.trim(F.regexp_replace(unescaped(F.regexp_replace(b, r"(?s)<[^>]*>", "")), r"\s+", " ")))
    return F.array_join(F.filter(plain, lambda b: F.length(b) > 20), "\n\n")


def page_metadata(html: Column) -> dict[str, Column]:
    """Title, description and Open Graph fields of a page, null where absent."""
    h = F.coalesce(html, F.lit(""))
    found = lambda p: F.when(F.regexp_extract(h, p, 1) != "", F.trim(unescaped(F.regexp_extract(h, p, 1))))
    out = {"title": found(r"(?is)<title\b[^>]*>(.*?)</title>"), "description": F.coalesce(found(r"(?i)<meta\s+name=[\"']description[\"']\s+content=[\"'](.*?)[\"']"), found(r"(?i)<meta\s+content=[\"'](.*?)[\"']\s+name=[\"']description[\"']"))}
    return out | {f"og_{n}": found(rf"(?i)property=[\"']og:{n}[\"']\s+content=[\"'](.*?)[\"']") for n in ("title", "description", "image")}


def page_jsonld(html: Column) -> Column:
    """The linked-data objects of a page that are sound JSON."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    return F.filter(F.transform(found, F.trim), lambda x: F.try_parse_json(x).isNotNull())


def page_tables(html: Column) -> Column:
    """The cells of a page's tables: tables of rows of cells, innermost tables
    only; empty rows are left out."""
    cell = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(unescaped(F.regexp_replace(c, r"(?s)<[^>]*>", "")), r"\s+", " ")))
    tables = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<table\b[^>]*>((?:(?!<table\b).)*?)</table>"), F.lit(1))
    return F.transform(tables, lambda t: F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1)), cell), lambda r: F.size(r) > 0))


def decode_sitemap(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """The locations of sitemaps and sitemap indexes: the columns of the table,
    ``position, url, is_index, lastmod`` (null where absent)."""
    xml = F.coalesce(F.col(payload), F.lit(""))
    entries = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:url|sitemap)>.*?</(?:url|sitemap)>"), F.lit(0))
    rows = payloads.select("*", F.posexplode(entries).alias("_at", "_e"))
    found = lambda tag: F.trim(unescaped(F.regexp_extract("_e", rf"(?s)<{tag}>(.*?)</{tag}>", 1)))
    out = rows.select(*payloads.columns, (F.col("_at") + 1).alias("position"), found("loc").alias("url"), F.col("_e").startswith("<sitemap").alias("is_index"), F.when(found("lastmod") != "", found("lastmod")).alias("lastmod"))
    return out.filter("url <> ''")
