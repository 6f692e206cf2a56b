"""The content root against a recursive walk of the tree, on written pages and on all pages of the test data."""

import html as entities
import random

import pytest
from gristmill.functions.nodes import tree
from gristmill.operators import content
from gristmill.operators.content import CANDIDATES, MARKERS, TAG_BONUS

PROSE = "These are words of a paragraph that goes on for a while and says something. "


class Node:
    def __init__(self, row, parent):
        self.pre, self.last, self.tag, self.cls, self.id, self.declared, self.chrome, self.link, _, self.text = row
        self.children = []
        if parent:
            parent.children.append(self)


def grown(page):
    """The nodes as a tree, parents found by their intervals."""
    out, open_ = [], []
    for row in tree(page):
        while open_ and open_[-1].last < row[0]:
            open_.pop()
        node = Node(row, open_[-1] if open_ else None)
        out.append(node)
        if node.tag:
            open_.append(node)
    return out


def summed(node):
    text, link, paragraphs = (len(node.text.encode()) if node.tag is None else 0), 0, 0
    for child in node.children:
        if child.chrome:
            continue
        a, b, c = summed(child)
        text, link, paragraphs = text + a, link + b, paragraphs + c
    if node.tag == "a":
        link = text
    if node.tag == "p" and text >= 25:
        paragraphs += 1
    return text, link, paragraphs


def root_by_hand(page):
    all_nodes = [n for n in grown(page) if n.tag]
    body = next((n for n in all_nodes if n.tag == "body"), None)
    if body is None:
        return None
    sums = {n.pre: summed(n) for n in all_nodes}

    def score(n):
        text, link, paragraphs = sums[n.pre]
        marks = sum(m in (v or "").lower() for v in (n.cls, n.id) for m in MARKERS)
        return text + 25 * paragraphs - 3 * link + TAG_BONUS.get(n.tag, 0) - 150 * min(marks, 3)

    good = [n for n in all_nodes if not n.chrome]
    best = lambda found: max(found, key=lambda n: (score(n), -n.pre), default=None)
    said = best([n for n in good if n.declared and n is not body]) or best([n for n in good if n.tag == "article"]) or best([n for n in good if n.tag == "main"])
    root = said or best([n for n in good if n.tag in CANDIDATES])
    text, link, _ = sums[root.pre]
    uncertain = text < 200 or (100 * link // text if text else 0) > 66
    root = body if uncertain else root
    text, link, paragraphs = sums[root.pre]
    whole = sums[body.pre][0]
    return root.pre, root.last, root.tag, score(root), text, 100 * link // text if text else 0, paragraphs, 100 * text // whole if whole else 0, said is not None and not uncertain, uncertain


def found(spark, pages):
    rows = content.page_nodes(spark.createDataFrame(pages, "page_id long, html string").repartition(3))
    return {r["page_id"]: tuple(r)[1:] for r in content.content_roots(rows).collect()}


def check(spark, pages):
    want = {i: w for i, p in pages if (w := root_by_hand(p))}
    assert found(spark, pages) == want
    return want


def random_page(r):
    def part(depth):
        tag = r.choice(["div", "section", "article", "main", "blockquote", "ul", "li", "p", "a", "nav", "footer", "td", "table", "span", "h2"])
        attrs = r.choice(["", "", "", ' class="Sidebar-widget promo"', ' id="comment-list"', ' itemprop="articleBody"', ' class="content"', ' property="SCHEMA:articleBody"'])
        inner = "".join(r.choice([lambda: part(depth - 1), lambda: PROSE * r.randint(1, 4), lambda: f"<p>{PROSE}</p>", lambda: f'<a href="/x">{PROSE[: r.randint(3, 60)]}</a>', lambda: "é&amp;x <br> y"])() for _ in range(r.randint(0, 4))) if depth else PROSE
        return f"<{tag}{attrs}>{inner}" + ("" if r.random() < 0.05 else f"</{tag}>")

    return r.choice(["<html><body>", "", "<!doctype html><title>x</title>"]) + "".join(part(4) for _ in range(3))


def test_roots_of_random_pages(spark):
    r = random.Random(1)
    want = check(spark, [(i, random_page(r)) for i in range(200)])
    kinds = {(w[2], w[-2], w[-1]) for w in want.values()}
    assert len({k[0] for k in kinds}) > 4 and {k[1:] for k in kinds} == {(True, False), (False, True), (False, False)}


def test_roots_of_all_pages(spark):
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").collect()]
    want = check(spark, pages)
    assert len(want) == len(pages)


def written(body):
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body,tag,declared,uncertain",
    [
        (f"<div id='menu'>{'<a href=/a>link text</a>' * 30}</div><div id='x'>{f'<p>{PROSE}</p>' * 5}</div>", "div", False, False),
        (f"<article>{PROSE * 4}</article><div itemprop='articleBody'>{PROSE * 3}</div><main>{PROSE * 9}</main>", "div", True, False),
        (f"<article>{PROSE * 3}</article><article>{PROSE * 5}</article>", "article", True, False),
        ("<article>short</article>" + PROSE, "body", False, True),
        (f"<main>{'<a href=/a>a link in a directory</a> ' * 40}</main>", "body", False, True),
        (f"<footer><article>{PROSE * 20}</article></footer><section>{PROSE * 4}</section>", "section", False, False),
        (f"<div class='sidebar related promo'>{PROSE * 6}</div><div>{PROSE * 3}</div><div>{PROSE * 3}</div>", "body", False, False),
    ],
)
def test_rules_of_the_root(spark, body, tag, declared, uncertain):
    got = check(spark, [(1, written(body))])[1]
    assert (got[2], got[-2], got[-1]) == (tag, declared, uncertain)


def test_first_of_equals_and_pages_without_nodes(spark):
    same = f"<div>{PROSE * 4}</div>"
    assert check(spark, [(1, f"<body class='comment share menu'>{same}{same}</body>"), (2, None), (3, ""), (4, "<!-- only a comment -->"), (5, "<title>no body</title>")])[1][0] == 2
    deep = "<div>" * 400 + PROSE * 9 + "</div>" * 400
    assert len(check(spark, [(1, deep), (2, "plain text & no tag")])) == 2


def test_text_of_the_root(spark):
    body = f"<nav>menu</nav><article><h1>A  head</h1><p>one <b>bo</b>ld</p><script>x()</script><ul><li>é&amp;1<li>2</ul><aside>no</aside>{PROSE * 3}</article><p>after</p>"
    rows = content.page_nodes(spark.createDataFrame([(1, written(body)), (2, "<p>a<p>b")], "page_id long, html string"))
    got = {r["page_id"]: r["text"] for r in content.root_texts(rows, content.content_roots(rows)).collect()}
    assert got == {1: entities.unescape(f"A head one bold é&amp;1 2 {PROSE * 3}").strip(), 2: "a b"}


def test_subtree_sums_of_any_forest(spark):
    from pyspark.sql import functions as F

    r, rows = random.Random(2), []

    def grow(page, depth):
        pre = len(rows_of[page])
        rows_of[page].append(None)
        for _ in range(r.randint(0, 4) if depth else 0):
            grow(page, depth - 1)
        rows_of[page][pre] = (page, pre, len(rows_of[page]) - 1, r.choice(["x", None]) if pre == len(rows_of[page]) - 1 else "x", r.randint(0, 9))

    rows_of = {p: [] for p in range(30)}
    for p in rows_of:
        grow(p, 4)
        rows += rows_of[p]
    df = spark.createDataFrame(rows, "page_id int, pre int, last int, tag string, v int")
    got = {(x["page_id"], x["pre"]): (x["s"], x["n"]) for x in content.subtree_sums(df, ["page_id"], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    assert got == {(p, a): (sum(x[4] for x in rows_of[p][a : b + 1]), b - a + 1) for p, a, b, tag, _ in rows if tag}
