"""The content root of pages: subtree sums over preorder intervals, scores, and the text of the root.

All thresholds are integers, and link density is in hundredths, so no decision depends on
rounding. Everything after the node rows happens within a page, by one shuffle of
narrow rows on the page's id, to as many tasks as the number of rows asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.nodes import nodes
from gristmill.functions.urls import collapse
from gristmill.storage import durable

# Fixed values of the content score.
MIN_PARAGRAPH, PARAGRAPH_BONUS, LINK_PENALTY, MARKER_PENALTY, MARKER_CAP, MIN_TEXT, MAX_DENSITY = 25, 25, 3, 150, 3, 200, 66
TAG_BONUS = {"article": 150, "main": 150, "section": 25, "blockquote": -25, "td": -50, "li": -50}
CANDIDATES = ("body", "article", "main", "section", "div", "blockquote", "td")
MARKERS = (
    "advert", "banner", "breadcrumb", "byline", "comment", "cookie", "disqus", "footer", "masthead", "menu",
    "nav-", "navbar", "navigation", "newsletter", "pagination", "popular", "promo", "related", "share", "sidebar",
    "site-info", "skip-link", "social", "sponsor", "subscribe", "toolbar", "trending", "widget", "-ad-", "_ad_",
)
#: Node rows that a task sorts, so that its memory does not grow with the pages.
ROWS_A_TASK = 100_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def page_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``page_id`` and the node rows of every page that has any."""
    return pages.select(F.col(key).alias("page_id"), F.inline(nodes(F.col(html))))


def subtree_sums(rows: DataFrame, key: list[str], values: dict[str, Column]) -> DataFrame:
    """The element rows with, for each name, the sum of its value over all rows of the subtree (``pre`` to ``last``).

    The sum of an interval is a difference of two prefix sums. So that no row has to look one up by
    number, every element also stands as a second row after the last of its subtree; one running sum over both
    gives it the two prefixes, and they meet by a grouping that needs no further shuffle.
    """
    opens = F.struct(F.col("pre").alias("at"), F.lit(0).alias("turn"))
    closes = F.struct(F.col("last").alias("at"), F.lit(1).alias("turn"))
    both = rows.withColumn("_event", F.explode(F.when(F.col("tag").isNull(), F.array(opens)).otherwise(F.array(opens, closes))))
    opening = F.col("_event.turn") == 0
    running = Window.partitionBy(*key).orderBy("_event.at", "_event.turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, value in values.items():
        own = F.when(opening, F.coalesce(value.cast("long"), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
        both = both.withColumn(f"_{name}", own).withColumn(f"_{name}_sum", F.sum(own).over(running))
    elements = both.where("tag is not null")
    kept = [c for c in rows.columns if c not in (*key, "pre")]
    sums = [(F.max(F.when(~opening, F.col(f"_{n}_sum"))) - F.max(F.when(opening, F.col(f"_{n}_sum") - F.col(f"_{n}")))).alias(n) for n in values]
    return elements.groupBy(*key, "pre").agg(*[F.first(c).alias(c) for c in kept], *sums)


def markers() -> Column:
    """Boilerplate marks in ``class`` and ``id``, MARKER_CAP at most."""
    lower = [F.translate(F.coalesce(F.col(c), F.lit("")), _UPPER, _UPPER.lower()) for c in ("class", "id")]
    hits = [v.contains(m).cast("int") for v in lower for m in MARKERS]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return F.least(total, F.lit(MARKER_CAP))


def element_scores(rows: DataFrame) -> DataFrame:
    """Elements outside navigation, headers, footers and asides, with ``marks, text_bytes, link_bytes, paragraphs, density, score``."""
    size = F.when(~F.col("chrome") & F.col("tag").isNull(), F.octet_length("text"))
    # What the texts, classes and ids are needed for is told here, so that only numbers and tags are shuffled and sorted.
    rows = rows.select("page_id", "pre", "last", "tag", "declared", "chrome", markers().alias("marks"), size.alias("size"), F.when(F.col("link"), size).alias("link_size"))
    rows = durable(rows, "elements")
    rows = rows.repartition(1 + rows.count() // ROWS_A_TASK, "page_id")
    sums = subtree_sums(rows, ["page_id"], {"text_bytes": F.col("size"), "link_bytes": F.col("link_size")}).drop("size", "link_size")
    counted = (F.col("tag") == "p") & ~F.col("chrome") & (F.col("text_bytes") >= MIN_PARAGRAPH)
    sums = subtree_sums(sums, ["page_id"], {"paragraphs": F.when(counted, 1)}).where("NOT chrome")
    density = F.when(F.col("text_bytes") > 0, F.floor(F.col("link_bytes") * 100 / F.col("text_bytes"))).otherwise(0)
    bonus = F.coalesce(F.create_map(*[F.lit(v) for pair in TAG_BONUS.items() for v in pair])[F.col("tag")], F.lit(0))
    score = F.col("text_bytes") + F.col("paragraphs") * PARAGRAPH_BONUS - F.col("link_bytes") * LINK_PENALTY + bonus - F.col("marks") * MARKER_PENALTY
    return sums.withColumn("density", density.cast("int")).withColumn("score", score)


def content_roots(rows: DataFrame) -> DataFrame:
    """``page_id, root, last, tag, score, text_bytes, density, paragraphs, share, declared, uncertain`` a page.

    A declared article body goes before any ``article``, that before any ``main``, and these before the
    container of highest score; of equals the first in the document. A root of little text, or of links for the most
    part, is not trusted: the body stands for it. ``share`` is the root's part of the body's text in hundredths.
    """
    kind = F.when(F.col("declared") & ~F.col("is_body"), 4).when(F.col("tag") == "article", 3).when(F.col("tag") == "main", 2).when(F.col("tag").isin(*CANDIDATES), 1)
    about = ["pre", "last", "tag", "score", "text_bytes", "density", "paragraphs"]
    first_body = F.min(F.when(F.col("tag") == "body", F.col("pre"))).over(Window.partitionBy("page_id"))
    scored = element_scores(rows).withColumn("is_body", F.col("pre") == first_body).withColumn("kind", kind)
    best = F.max(F.when(F.col("kind").isNotNull(), F.struct("kind", F.col("score").alias("rank"), (-F.col("pre")).alias("first"), *about))).alias("best")
    body = F.min(F.when(F.col("is_body"), F.struct(*about))).alias("body")
    page = scored.groupBy("page_id").agg(best, body)
    uncertain = (F.col("best.text_bytes") < MIN_TEXT) | (F.col("best.density") > MAX_DENSITY)
    page = page.select("page_id", "body", "best", uncertain.alias("uncertain")).where("body is not null")
    of = lambda c: F.when(F.col("uncertain"), F.col(f"body.{c}")).otherwise(F.col(f"best.{c}"))
    share = F.when(F.col("body.text_bytes") > 0, F.floor(of("text_bytes") * 100 / F.col("body.text_bytes"))).otherwise(0).cast("int")
    named = [of(c).alias("root" if c == "pre" else c) for c in about]
    return page.select("page_id", *named, share.alias("share"), ((F.col("best.kind") > 1) & ~F.col("uncertain")).alias("declared"), "uncertain")


def root_texts(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``page_id, text`` for every page with a root: the root's text runs in document order, white space collapsed."""
    runs = rows.where("tag is null AND NOT chrome").select("page_id", F.col("pre").alias("at"), F.concat(F.when(F.col("gap"), F.lit(" ")).otherwise(F.lit("")), "text").alias("run"))
    inside = roots.select("page_id", "root", "last").join(runs, "page_id", "left")
    held = F.collect_list(F.when(F.col("at").between(F.col("root"), F.col("last")), F.struct("at", "run")))
    return inside.groupBy("page_id").agg(held.alias("runs")).select("page_id", collapse(F.array_join(F.transform(F.array_sort("runs"), lambda r: r["run"]), "")).alias("text"))
