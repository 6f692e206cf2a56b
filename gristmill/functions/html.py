"""Readable content of HTML pages, as one Arrow-batched function.

Spark has no HTML parser, so each page is walked once in Python (standard
library parser, in batches); everything that follows (links to edges, degrees,
digests) is DataFrame work on the struct that comes back.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.batches import pieces

SCHEMA = (
    "title string, description string, lang string, canonical string, markdown string, text string, noindex boolean, nofollow boolean, link_density int,"
    " headings array<struct<level:int,text:string>>, links array<struct<href:string,anchor:string,kind:string,rel:string>>, feeds array<string>"
)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object", "form", "button", "select", "textarea"}
CHROME = {"nav", "header", "footer", "aside"}
#: An opening tag on the left ends open elements on the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "li", "table", "tr", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "dl", "dt", "dd", "nav", "header", "footer", "aside"}
MAX_DEPTH, MAX_LINKS, MAX_HEADINGS, MAX_FEEDS = 256, 5000, 64, 16
_SPACE = re.compile("[ \t\n\f\r]+")


def cut(text: str, n_bytes: int) -> str:
    """The longest start of the text in so many UTF-8 bytes."""
    return text.encode()[:n_bytes].decode(errors="ignore")


def collapse(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


class Page(HTMLParser):
    """One pass over a page: metadata, links by place, and the markdown of what is neither dropped nor chrome."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.base, self.stack = url, []
        self.out: list[str] = []
        self.lang = self.canonical = self.title = self.og_title = self.description = self.og_description = None
        self.links, self.headings, self.feeds = [], [], []
        self.noindex = self.nofollow = False
        self.title_parts: list[str] | None = None
        self.anchor: list | None = None
        self.heading: list | None = None
        self.text_bytes = self.link_bytes = 0

    def inside(self, names: set[str]) -> bool:
        return any(t in names for t in self.stack)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = self.lang or a.get("lang") or None
        elif tag == "base" and "href" in a:
            self.base = self.join(a["href"]) or self.base
        elif tag == "meta":
            self.meta(a)
        elif tag == "link":
            self.link(a)
        elif tag == "title" and self.title is None and not self.inside({"svg"}):
            self.title_parts = []
        if tag in VOID:
            if tag == "br":
                self.emit("\n")
            elif tag == "hr":
                self.emit("\n\n---\n\n")
            elif tag == "img" and a.get("src") and not self.hidden():
                self.emit(f"![{collapse(a.get('alt', ''))}]({self.join(a['src']) or ''})")
            return
        if tag in BLOCKS and "p" in self.stack:
            self.close("p")
        while self.stack and self.stack[-1] in CLOSES.get(tag, ()):
            self.close(self.stack[-1])
        if len(self.stack) < MAX_DEPTH:
            self.stack.append(tag)
        if re.fullmatch("h[1-6]", tag):
            self.emit("\n\n" + "#" * int(tag[1]) + " ")
            self.heading = [int(tag[1]), []]
        elif tag == "li":
            depth = sum(t in ("ul", "ol") for t in self.stack) - 1
            self.emit("\n" + "  " * max(depth, 0) + ("1. " if next((t for t in reversed(self.stack) if t in ("ul", "ol")), "ul") == "ol" else "- "))
        elif tag == "pre":
            language = re.search(r"\blang(?:uage)?-([\w+#-]+)", a.get("class", ""))
            self.emit(f"\n\n```{language[1] if language else ''}\n")
        elif tag == "blockquote":
            self.emit("\n\n> ")
        elif tag in ("td", "th"):
            self.emit(" | ")
        elif tag == "tr":
            self.emit("\n")
        elif tag in BLOCKS:
            self.emit("\n\n")
        elif tag in ("strong", "b"):
            self.emit("**")
        elif tag in ("em", "i"):
            self.emit("*")
        elif tag == "code" and "pre" not in self.stack:
            self.emit("`")
        elif tag == "a":
            self.end_anchor()
            if "href" in a:
                self.anchor = [a["href"], [], "nav" if self.inside(CHROME) else "body", a.get("rel", "").lower()]

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack and self.stack[-1] != tag:
                self.close(self.stack[-1])
            self.close(tag)

    def close(self, tag: str) -> None:
        while self.stack:
            top = self.stack.pop()
            if top == "title" and self.title_parts is not None:
                self.title, self.title_parts = collapse("".join(self.title_parts)) or None, None
            elif top == "a":
                self.end_anchor()
            elif re.fullmatch("h[1-6]", top) and self.heading:
                level, parts = self.heading
                if level <= 3 and len(self.headings) < MAX_HEADINGS and (text := collapse("".join(parts))):
                    self.headings.append((level, cut(text, 300)))
                self.heading = None
            elif top == "pre":
                self.emit("\n```\n\n")
            elif top in ("strong", "b"):
                self.emit("**")
            elif top in ("em", "i"):
                self.emit("*")
            elif top == "code" and "pre" not in self.stack:
                self.emit("`")
            if top == tag:
                break

    def hidden(self) -> bool:
        return self.inside(DROPPED) or self.inside(CHROME) or self.inside({"head", "title"})

    def emit(self, text: str) -> None:
        if not self.hidden():
            (self.anchor[1] if self.anchor else self.out).append(text)

    def handle_data(self, data):
        if self.title_parts is not None:
            self.title_parts.append(data)
        if self.inside(DROPPED):
            return
        if self.heading:
            self.heading[1].append(data)
        if self.anchor and self.hidden():
            self.anchor[1].append(data)
        elif not self.hidden():
            n = len(collapse(data).encode())
            self.text_bytes += n
            self.link_bytes += n if self.anchor else 0
            self.emit(data if "pre" in self.stack else _SPACE.sub(" ", data))

    def end_anchor(self) -> None:
        if not self.anchor:
            return
        href, parts, kind, rel = self.anchor
        self.anchor = None
        text, target = collapse("".join(parts)), self.join(href)
        if target and len(self.links) < MAX_LINKS:
            row = (target, cut(text, 200), kind, rel)
            if row not in self.links:
                self.links.append(row)
        if not self.hidden():
            self.out.append(f"[{text}]({target})" if target and text else text)

    def join(self, href: str) -> str | None:
        try:
            made = urljoin(self.base, href.strip()).partition("#")[0]
        except ValueError:
            return None
        return made if made.startswith(("http://", "https://")) else None

    def meta(self, a: dict[str, str]) -> None:
        name, content = (a.get("name") or a.get("property") or "").lower(), collapse(a.get("content", ""))
        if name == "robots":
            values = {v.strip() for v in content.lower().split(",")}
            self.noindex |= bool(values & {"noindex", "none"})
            self.nofollow |= bool(values & {"nofollow", "none"})
        elif name == "description":
            self.description = self.description or content or None
        elif name == "og:description":
            self.og_description = self.og_description or content or None
        elif name == "og:title":
            self.og_title = self.og_title or content or None

    def link(self, a: dict[str, str]) -> None:
        rel, target = set(a.get("rel", "").lower().split()), self.join(a.get("href", ""))
        if target and "canonical" in rel:
            self.canonical = self.canonical or target
        if target and "alternate" in rel and a.get("type", "").lower() in ("application/rss+xml", "application/atom+xml") and len(self.feeds) < MAX_FEEDS:
            self.feeds.append(target)

    def end(self) -> None:
        self.close("")
        self.end_anchor()

    def found_title(self) -> str | None:
        title = self.title or self.og_title or next((t for level, t in self.headings if level == 1), None)
        return title and cut(title, 512)

    def shown_title(self) -> str | None:
        self.end()
        return None if self.noindex else self.found_title()

    def result(self) -> tuple:
        self.end()
        fences = re.split(r"(```[^\n]*\n.*?\n```)", "".join(self.out), flags=re.S)
        parts = [f if i % 2 else re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *(?![ \-1])", "\n", re.sub(r"[ \t]{2,}(?![-1])", " ", f))) for i, f in enumerate(fences)]
        markdown = "".join(parts).strip()
        density = 100 * self.link_bytes // self.text_bytes if self.text_bytes else 0
        description = self.description or self.og_description or first_paragraph(markdown)
        keep = (lambda x: None) if self.noindex else (lambda x: x)
        return (
            keep(self.found_title()), keep(description and cut(description, 1024)), self.lang, self.canonical, keep(markdown), keep(plain_text(markdown)), self.noindex, self.nofollow,
            density, self.headings, self.links, self.feeds,
        )


def plain_text(markdown: str) -> str:
    """Markdown without its marks, white space collapsed, composed (NFC)."""
    text = re.sub(r"^```.*$", "", markdown, flags=re.M)
    text = re.sub(r"^\s*(?:#{1,6} |[-*] |\d+\. |> )", "", text, flags=re.M)
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    return unicodedata.normalize("NFC", collapse(re.sub(r"\*\*|[*`|]", "", text)))


def first_paragraph(markdown: str) -> str | None:
    """The first prose paragraph of some length, up to 300 bytes at a word's end."""
    for block in re.split(r"\n\s*\n", markdown):
        if not re.match(r"\s*(?:#|[-*|>] |\d+\. |```|\|)", block) and len(text := plain_text(block)) >= 40:
            short = cut(text, 300)
            return short if short == text else short.rpartition(" ")[0] or short
    return None


def walk(page: str | None, url: str | None) -> Page:
    walker = Page(url or "")
    walker.feed(page or "")
    if walker.rawdata and not walker.rawdata.startswith("<"):
        walker.handle_data(entities.unescape(walker.rawdata))
    return walker


def extract_page(page: str | None, url: str | None) -> tuple:
    return walk(page, url).result()


_LINK = pa.struct([(c, pa.string()) for c in ("href", "anchor", "kind", "rel")])
_HEADING = pa.struct([("level", pa.int32()), ("text", pa.string())])
_FIELDS = {
    **{c: pa.string() for c in ("title", "description", "lang", "canonical", "markdown", "text")},
    "noindex": pa.bool_(), "nofollow": pa.bool_(), "link_density": pa.int32(), "headings": pa.list_(_HEADING), "links": pa.list_(_LINK), "feeds": pa.list_(pa.string()),
}


def _walked(html: list[str | None], url: list[str | None]) -> pa.StructArray:
    columns = dict(zip(_FIELDS, zip(*map(extract_page, html, url))))
    named = lambda rows, kind: [[dict(zip(kind.names, x)) for x in r] for r in rows]
    columns |= {"headings": named(columns["headings"], _HEADING), "links": named(columns["links"], _LINK)}
    return pa.StructArray.from_arrays([pa.array(columns[c], kind) for c, kind in _FIELDS.items()], fields=[pa.field(c, kind) for c, kind in _FIELDS.items()])


def _extract(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for html, url in batches:
        for piece in pieces(html, url):
            yield _walked(*piece)


def _titles(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for html, url in batches:
        for piece in pieces(html, url):
            yield pa.array([walk(h, u).shown_title() for h, u in zip(*piece)], pa.string())


def extract(html: Column, url: Column) -> Column:
    """A struct of SCHEMA. Pages that forbid indexing keep their links and lose their content."""
    return F.arrow_udf(_extract, SCHEMA)(html, url)


def title(html: Column, url: Column) -> Column:
    """``extract``'s title alone; no text of the page leaves the worker."""
    return F.arrow_udf(_titles, "string")(html, url)
