"""What polls of feeds and sitemaps say that was not known: new items, moved dates, visits to bring forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.sources.crawl_tables import FAILED, FETCHED, PENDING


def poll_changes(polls: DataFrame, *ties: str) -> DataFrame:
    """``url, kind, published_ms, polled_ms``: the rows of ``polls`` (``url, published_ms, polled_ms``) that tell something.

    ``item`` is a URL's first row, in order of ``polled_ms`` and ``ties``; ``updated``
    one whose date is none of null and the last date known. A null URL gives no row.
    """
    earlier = Window.partitionBy("url").orderBy("polled_ms", *ties).rowsBetween(Window.unboundedPreceding, -1)
    # The date known is the last that is not null: one that is null is never taken over another.
    seen = polls.where("url is not null").withColumn("_n", F.count(F.lit(1)).over(earlier)).withColumn("_known", F.last("published_ms", ignorenulls=True).over(earlier))
    moved = F.col("published_ms").isNotNull() & ~F.col("published_ms").eqNullSafe(F.col("_known"))
    kind = F.when(F.col("_n") == 0, "item").when(moved, "updated")
    return seen.withColumn("kind", kind).where("kind is not null").select("url", "kind", "published_ms", "polled_ms")


def bring_forward(ledger: DataFrame, candidates: DataFrame) -> DataFrame:
    """``url_key, due_before, next_due_ms`` of the ledger's rows whose visit comes forward.

    A candidate (``url_key, lastmod_ms, discovered_ms``) with a date after the last
    fetch makes a row due when it was found, unless it is due by then, leased, or in a
    state that is not scheduled. Of several the earliest counts, whatever their order.
    """
    each = candidates.where("lastmod_ms is not null").groupBy("url_key", "lastmod_ms").agg(F.min("discovered_ms").alias("discovered_ms"))
    open_ = ledger.where(F.col("state").isin(PENDING, FETCHED, FAILED) & ~F.coalesce("leased", F.lit(False)))
    news = each.join(open_.select("url_key", F.col("next_due_ms").alias("due_before"), F.coalesce("last_fetch_ms", F.lit(0)).alias("_last")), "url_key")
    news = news.where((F.col("lastmod_ms") > F.col("_last")) & (F.col("discovered_ms") < F.col("due_before")))
    return news.groupBy("url_key").agg(F.any_value("due_before").alias("due_before"), F.min("discovered_ms").alias("next_due_ms"))
