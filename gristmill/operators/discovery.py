"""Nested sitemaps: breadth-first discovery by rounds of joins, with depth, file and URL caps, safe on cycles.

A round joins what is new with the documents that exist and follows their entries. What was met before is
taken out by an anti join, so two indexes that point at each other end at once. The caps cut the
breadth-first order of an origin at one place, so they are applied after the rounds by running sums: what a
document behind the cut would have added lies behind the cut too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.urls import origin
from gristmill.sources.feeds import feed, sitemap
from gristmill.storage import durable

# Fixed values.
MAX_DEPTH, MAX_FILES, MAX_URLS = 3, 50_000, 50_000_000


def sitemap_files(bodies: DataFrame, url: str = "url", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """``file, n_urls`` of every fetched document, and ``file, place, target`` of the sitemaps that its entries name. What is no sitemap is read as a feed."""
    read = durable(bodies.select(F.col(url).alias("file"), F.coalesce(sitemap(F.col(body)), F.array()).alias("entries"), F.coalesce(feed(F.col(body)), F.array()).alias("items")), "sitemaps")
    pages = F.filter("entries", lambda e: ~e["is_index"])
    files = read.select("file", F.when(F.size("entries") > 0, F.size(pages)).otherwise(F.size("items")).cast("long").alias("n_urls"))
    nested = read.select("file", F.posexplode(F.filter("entries", lambda e: e["is_index"])).alias("place", "entry")).select("file", "place", F.col("entry.url").alias("target"))
    return files, nested


def discover(starts: DataFrame, files: DataFrame, nested: DataFrame, *, max_depth: int = MAX_DEPTH, max_files: int = MAX_FILES, max_urls: int = MAX_URLS, same_origin: Column | None = None) -> DataFrame:
    """``origin, file, depth, fate, taken, cut`` of every sitemap that is named, in breadth-first order of its origin (``position``).

    ``starts`` have ``origin, place, file``; ``files`` the documents that exist (``file, n_urls``, and ``allowed`` where robots rules were asked);
    ``nested`` what they name (``file, place, target``). ``fate`` is off_origin, disallowed, missing, fetched or capped (behind the cut); ``taken`` is how
    many of its URLs fit under the cap and ``cut`` whether some did not. ``same_origin`` is over ``origin`` and ``file``.
    """
    own = F.coalesce(origin(F.col("file")) == F.col("origin"), F.lit(False)) if same_origin is None else same_origin
    allowed = F.coalesce(F.col("allowed"), F.lit(True)) if "allowed" in files.columns else F.lit(True)
    known = files.select("file", F.coalesce("n_urls", F.lit(0)).alias("n_urls"), allowed.alias("allowed")).dropDuplicates(["file"])
    ranked = lambda rows, *order: rows.withColumn("rank", F.row_number().over(Window.partitionBy("origin").orderBy(*order)))
    named = starts.where("file is not null").groupBy("origin", "file").agg(F.min("place").alias("place"))
    new = ranked(named, "place", "file").select("origin", "file", "rank")
    met = None
    for depth in range(max_depth + 1):
        looked = new.join(known, "file", "left").withColumn("depth", F.lit(depth))
        fate = F.when(~own, "off_origin").when(F.col("allowed") == F.lit(False), "disallowed").when(F.col("n_urls").isNull(), "missing").otherwise("fetched")
        level = durable(looked.select("origin", "file", "depth", "rank", fate.alias("fate"), F.coalesce("n_urls", F.lit(0)).cast("long").alias("n_urls")), "level")
        met = level if met is None else met.unionByName(level)
        if depth == max_depth or level.where("fate = 'fetched'").isEmpty():
            break
        follow = level.where("fate = 'fetched'").join(nested.where("target is not null"), "file").select("origin", F.col("target").alias("file"), F.struct("rank", "place").alias("by"))
        first = follow.groupBy("origin", "file").agg(F.min("by").alias("by")).join(met.select("origin", "file"), ["origin", "file"], "left_anti")
        new = ranked(first, "by", "file").select("origin", "file", "rank")
    order = Window.partitionBy("origin").orderBy("depth", "rank")
    fetched = F.col("fate") == "fetched"
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = met.withColumns({
        "position": F.row_number().over(order), "_files": F.coalesce(F.count_if(fetched).over(before), F.lit(0)), "_urls": F.coalesce(F.sum(F.when(fetched, F.col("n_urls"))).over(before), F.lit(0)),
    })
    capped = (F.col("_files") >= max_files) | (F.col("_urls") >= max_urls)
    taken = F.when(fetched & ~capped, F.least(F.col("n_urls"), max_urls - F.col("_urls"))).otherwise(0).cast("long")
    return out.select("origin", "file", "depth", "position", F.when(capped, "capped").otherwise(F.col("fate")).alias("fate"), taken.alias("taken"), (fetched & ~capped & (taken < F.col("n_urls"))).alias("cut"))


def discovery_report(found: DataFrame) -> DataFrame:
    """Per origin: ``files, urls, off_origin, disallowed, missing, truncated``."""
    of = lambda fate: F.count_if(F.col("fate") == fate)
    return found.groupBy("origin").agg(of("fetched").alias("files"), F.sum("taken").alias("urls"), of("off_origin").alias("off_origin"), of("disallowed").alias("disallowed"), of("missing").alias("missing"), F.bool_or(F.col("cut") | (F.col("fate") == "capped")).alias("truncated"))
