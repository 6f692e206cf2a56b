"""The node rows of HTML pages: elements and text runs in document order, with the interval that each subtree covers.

Spark has no HTML parser, so a page is read once in Python (standard library parser, in
batches) into rows; whatever is asked of the tree after that is DataFrame work,
because a subtree is the rows whose number lies in an interval.

Rules: a null page has no nodes. ``body`` is opened by the first content where it is not
written. Void elements are leaves. Elements deeper than MAX_DEPTH are left out, their text
belongs to the last one kept. Text of dropped elements and of blank runs gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.batches import pieces
from gristmill.functions.html import BLOCKS, CHROME, CLOSES, MAX_DEPTH, VOID

#: ``tag`` is null for a text run, of which ``text`` has its white space collapsed; ``gap`` tells that a block began or ended since the last run.
SCHEMA = "array<struct<pre:int,last:int,tag:string,class:string,id:string,declared:boolean,chrome:boolean,link:boolean,gap:boolean,text:string>>"
#: Elements whose subtree is not content.
DROPPED = {"script", "style", "noscript", "svg", "canvas", "iframe", "object", "embed", "input", "button", "select", "textarea", "option", "template", "label", "legend"}
HEAD = {"html", "head", "title", "meta", "link", "base"}
_SPACE = re.compile("[ \t\n\f\r]+")


class Tree(HTMLParser):
    """Rows in document order, an open element's ``last`` still open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        #: Of open elements: (tag, row number or -1 where the depth is exceeded).
        self.stack: list[tuple[str, int]] = []
        self.dropped = self.chrome = self.anchors = 0
        self.has_body = False
        self.gap = True

    def body(self) -> None:
        if not self.has_body:
            while self.stack and self.stack[-1][0] != "html":
                self.pop()
            if not self.stack:
                self.push("html", {})
            self.push("body", {})

    def push(self, tag: str, a: dict[str, str]) -> None:
        self.has_body |= tag == "body"
        self.chrome += tag in CHROME
        self.anchors += tag == "a"
        number = -1
        if len(self.stack) < MAX_DEPTH:
            number = len(self.rows)
            said = a.get("itemprop") == "articleBody" or a.get("property", "").lower() in ("articlebody", "schema:articlebody")
            self.rows.append([number, number, tag, a.get("class"), a.get("id"), said, self.chrome > 0, self.anchors > 0, False, None])
        self.stack.append((tag, number))

    def pop(self) -> None:
        tag, number = self.stack.pop()
        self.chrome -= tag in CHROME
        self.anchors -= tag == "a"
        self.gap |= tag in BLOCKS
        if number >= 0:
            self.rows[number][1] = len(self.rows) - 1

    def close(self, tag: str) -> None:
        while self.stack and self.stack[-1][0] != tag:
            self.pop()
        if self.stack:
            self.pop()

    def handle_starttag(self, tag, attrs):
        if self.dropped:
            self.dropped += tag not in VOID
            return
        if tag in DROPPED:
            self.dropped = int(tag not in VOID)
            return
        a = {k: v or "" for k, v in attrs}
        names = [t for t, _ in self.stack]
        if tag in ("html", "body") and tag in names:
            return
        if tag == "body":
            while self.stack and self.stack[-1][0] != "html":
                self.pop()
            if not self.stack:
                self.push("html", {})
        elif tag not in HEAD:
            self.body()
        if tag in BLOCKS and "p" in names:
            self.close("p")
        if tag == "a" and "a" in names:
            self.close("a")
        while self.stack and self.stack[-1][0] in CLOSES.get(tag, ()):
            self.pop()
        self.gap |= tag in BLOCKS or tag == "br"
        self.push(tag, a)
        if tag in VOID:
            self.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.dropped:
            self.dropped -= tag not in VOID
        elif tag not in ("html", "body") and any(t == tag for t, _ in self.stack):
            self.close(tag)

    def handle_data(self, data):
        text = _SPACE.sub(" ", data)
        if self.dropped or text in ("", " "):
            self.gap |= text == " "
            return
        if not self.stack or self.stack[-1][0] in ("html", "head"):
            self.body()
        number = len(self.rows)
        self.gap |= text[0] == " "
        self.rows.append([number, number, None, None, None, False, self.chrome > 0, self.anchors > 0, self.gap, text.strip(" ")])
        self.gap = text[-1] == " "


def tree(page: str | None) -> list[tuple]:
    walker = Tree()
    walker.feed(page or "")
    HTMLParser.close(walker)
    while walker.stack:
        walker.pop()
    return [tuple(r) for r in walker.rows]


_FIELDS = [
    pa.field("pre", pa.int32()), pa.field("last", pa.int32()), *[pa.field(c, pa.string()) for c in ("tag", "class", "id")],
    *[pa.field(c, pa.bool_()) for c in ("declared", "chrome", "link", "gap")], pa.field("text", pa.string()),
]


def _trees(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        for (piece,) in pieces(pages):
            trees = [tree(p) for p in piece]
            rows = list(chain.from_iterable(trees))
            columns = list(zip(*rows)) or [()] * len(_FIELDS)
            held = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS)], fields=_FIELDS)
            yield pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, trees))], pa.int32()), held)


def nodes(html: Column) -> Column:
    """The rows of a page, an array of SCHEMA's struct."""
    return F.arrow_udf(_trees, SCHEMA)(html)
