"""Sitemaps, feeds and seed lists as expressions over their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import urls
from gristmill.functions.dates import any_date, rfc822, w3c

_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _text(xml: Column) -> Column:
    """The text of an element's inside: CDATA unwrapped, the five entities decoded."""
    out = F.regexp_replace(xml, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for name, char in _ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(out)


def _child(block: Column, name: str) -> Column:
    return F.nullif(_text(F.regexp_extract(block, rf"(?s)<(?:[\w.-]+:)?{name}(?:\s[^>]*)?>(.*?)</(?:[\w.-]+:)?{name}\s*>", 1)), F.lit(""))


def sitemap(text: Column) -> Column:
    """``array<struct<url, lastmod_ms, is_index>>`` of an XML sitemap or index, or of a text one (a URL a line)."""
    clean = F.regexp_replace(text, "(?s)<!--.*?-->", "")
    blocks = lambda tag: F.regexp_extract_all(clean, F.lit(rf"(?s)<(?:[\w.-]+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:[\w.-]+:)?{tag}\s*>"), F.lit(1))
    row = lambda b, index: F.struct(_child(b, "loc").alias("url"), w3c(_child(b, "lastmod")).alias("lastmod_ms"), F.lit(index).alias("is_index"))
    xml = F.concat(F.transform(blocks("url"), lambda b: row(b, False)), F.transform(blocks("sitemap"), lambda b: row(b, True)))
    lines = F.filter(F.transform(F.split(text, "\r\n|\r|\n"), F.trim), lambda x: x.rlike("^(?i:https?)://"))
    plain = F.transform(lines, lambda u: F.struct(u.alias("url"), F.lit(None).cast("long").alias("lastmod_ms"), F.lit(False).alias("is_index")))
    return F.filter(F.when(F.ltrim(text).startswith("<"), xml).otherwise(plain), lambda r: r["url"].isNotNull())


def feed(text: Column) -> Column:
    """``array<struct<url, updated_ms>>`` of RSS, RDF and Atom: the link, else the guid unless it says it is none; updated before published."""
    items = F.regexp_extract_all(text, F.lit(r"(?s)<(?:[\w.-]+:)?(?:item|entry)(?:\s[^>]*)?>(.*?)</(?:[\w.-]+:)?(?:item|entry)\s*>"), F.lit(1))

    def row(b: Column) -> Column:
        atom = F.nullif(_text(F.regexp_extract(b, r"""<link\b(?![^>]*rel=["'](?!alternate))[^>]*href=["']([^"']*)["']""", 1)), F.lit(""))
        guid = F.when(~b.rlike(r"""<guid\b[^>]*isPermaLink=["']false["']"""), _child(b, "guid"))
        at = F.coalesce(any_date(_child(b, "updated")), any_date(_child(b, "date")), rfc822(_child(b, "pubDate")), w3c(_child(b, "published")))
        return F.struct(F.coalesce(_child(b, "link"), atom, guid).alias("url"), at.alias("updated_ms"))

    return F.filter(F.transform(items, row), lambda r: r["url"].isNotNull())


def seeds(lines: DataFrame, column: str = "value", max_bytes: int = 2048) -> DataFrame:
    """``url, error`` of a seed list: blank lines, comments and over-long lines go; one row for each canonical URL or reject."""
    line = F.trim(column)
    kept = lines.where((F.octet_length(column) <= max_bytes) & (line != "") & ~line.startswith("#"))
    return kept.select(urls.canonical(line).alias("c")).select("c.url", "c.error").dropDuplicates(["url", "error"])
