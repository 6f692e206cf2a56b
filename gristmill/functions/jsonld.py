"""Structured data of pages: JSON-LD blocks walked as variants, inside one row.

A walk goes a level a step, through the elements of arrays and the ``@graph`` of objects, to
MAX_DEPTH; objects are then taken in document order, the first that has a field gives it. A block
that is not JSON, or repeats a key in an object, is skipped. Null and empty pages have no objects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.urls import collapse

#: Levels below a block that are still read, bytes a field is cut to, blocks of a page, bytes of a block beyond which it is skipped.
MAX_DEPTH = 8
MAX_FIELD = 128
MAX_BLOCKS, MAX_BLOCK_BYTES = 16, 256 * 1024
_BLOCK = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?\s*application/ld\+json\b[^>]*>(.*?)</script"""


def blocks(html: Column) -> Column:
    """The texts of a page's first JSON-LD scripts."""
    return F.filter(F.slice(F.regexp_extract_all(html, F.lit(_BLOCK), F.lit(1)), 1, MAX_BLOCKS), lambda x: F.octet_length(x) <= MAX_BLOCK_BYTES)


def cut_bytes(text: Column, most: int) -> Column:
    """The longest start of the text in so many UTF-8 bytes."""
    digits = F.hex(F.encode(text, "UTF-8"))
    start, goes_on = F.substring(digits, 1, 2 * most), F.substring(digits, 2 * most + 1, 1).isin("8", "9", "A", "B")
    whole = F.when(goes_on, F.regexp_replace(start, "^((?:..)*?)[C-F].(?:[89AB].){0,2}$", "$1")).otherwise(start)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.unhex(whole), "UTF-8"))


def _member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f'$["{name}"]', "variant")


def _list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _string(value: Column) -> Column:
    """A string with its white space collapsed; null where it is empty or the value of another kind."""
    text = collapse(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")))
    return F.when(text != "", text)


def _field(value: Column) -> Column:
    return cut_bytes(_string(value), MAX_FIELD)


def _known(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def objects(texts: Column) -> Column:
    """``array<struct<path, v>>``: the objects of JSON texts in document order, a path their places from the text down."""
    place = lambda path, v: F.struct(path.alias("path"), v.alias("v"))
    kind = "array<struct<path:array<int>,v:variant>>"
    top = F.transform(texts, lambda text, i: place(F.array(i), F.try_parse_json(text)))

    def below(x: Column) -> Column:
        inner = F.transform(_list(x["v"]), lambda v, i: place(F.concat(x["path"], F.array(i)), v))
        graph = _member(x["v"], "@graph")
        return F.coalesce(inner, F.when(graph.isNotNull(), F.array(place(F.concat(x["path"], F.array(F.lit(0))), graph))), F.array().cast(kind))

    def step(done: Column, _: Column) -> Column:
        found = F.filter(done["level"], lambda x: F.try_variant_get(x["v"], "$", "map<string,variant>").isNotNull())
        return F.struct(F.flatten(F.transform(done["level"], below)).alias("level"), F.concat(done["seen"], found).alias("seen"))

    start = F.struct(F.coalesce(top, F.array().cast(kind)).cast(kind).alias("level"), F.array().cast(kind).alias("seen"))
    order = lambda x, y: F.when(x["path"] < y["path"], -1).when(x["path"] > y["path"], 1).otherwise(0)
    return F.aggregate(F.sequence(F.lit(0), F.lit(MAX_DEPTH)), start, step, lambda done: F.array_sort(done["seen"], order))


def _types(value: Column) -> Column:
    kind = _member(value, "@type")
    return _known(F.transform(F.coalesce(_list(kind), F.array(kind)), _field))


def _author(value: Column, depth: int = 2) -> Column:
    """A string, an object's name, or the first of a list that is either; lists in lists to ``depth``."""
    one = F.coalesce(_string(value), _string(_member(value, "name")))
    return F.coalesce(one, F.get(_known(F.transform(_list(value), lambda v: _author(v, depth - 1))), F.lit(0))) if depth else one


def structured(found: Column, content: Column | None = None) -> Column:
    """``types, published, modified, headline, author`` of ``objects``; the last two are null where ``content`` is false."""
    first = lambda f: F.get(_known(F.transform(found, lambda x: f(x["v"]))), F.lit(0))
    keep = lambda c: c if content is None else F.when(content, c)
    return F.struct(
        F.array_distinct(F.flatten(F.transform(found, lambda x: _types(x["v"])))).alias("types"),
        first(lambda v: _field(_member(v, "datePublished"))).alias("published"),
        first(lambda v: _field(_member(v, "dateModified"))).alias("modified"),
        keep(first(lambda v: _field(_member(v, "headline")))).alias("headline"),
        keep(cut_bytes(first(lambda v: _author(_member(v, "author"))), MAX_FIELD)).alias("author"),
    )
