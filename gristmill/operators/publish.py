"""Published files: manifests, their chain, verification, retraction, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_entries(rows: DataFrame, day: Column, part: Column, size: Column) -> DataFrame:
    """``day, path, rows, bytes``: a file for each day and part."""
    path = F.concat(F.lit("data/"), F.date_format(day, "yyyy/MM/dd"), F.lit("/part-"), part.cast("string"), F.lit(".parquet"))
    return rows.groupBy(F.date_format(day, "yyyy-MM-dd").alias("day"), path.alias("path")).agg(F.count("*").alias("rows"), F.sum(size).cast("long").alias("bytes"))


def manifests(entries: DataFrame) -> DataFrame:
    """``day, files, rows, bytes, digest, prev``: each day's totals and a digest over its entries in path order; ``prev`` is the digest of the day before."""
    line = F.concat_ws(" ", "path", F.col("rows").cast("string"), F.col("bytes").cast("string"))
    days = entries.groupBy("day").agg(
        F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"),
    )
    return days.withColumn("prev", F.lag("digest").over(Window.orderBy("day")))  # a row a day


def verify_chain(days: DataFrame) -> DataFrame:
    """Days whose ``prev`` is not the digest of the day before."""
    follows = F.lag("digest").over(Window.orderBy("day"))
    return days.withColumn("expected", follows).where(~F.col("prev").eqNullSafe(F.col("expected"))).drop("expected")


def retract(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """The entries without those to take back. Manifests made of them give the new chain."""
    return entries.join(paths.select("path").distinct(), "path", "left_anti")


def changed_days(before: DataFrame, after: DataFrame) -> DataFrame:
    """Days with another digest, or none, after a change: ``day, status``."""
    a, b = before.select("day", F.col("digest").alias("_a")), after.select("day", F.col("digest").alias("_b"))
    both = a.join(b, "day", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select("day", F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "added").otherwise("changed").alias("status"))


def compare_listing(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """Each path's status: ``ok``, ``missing`` from the listing, of another ``size``, or ``unnamed`` by the entries."""
    a = entries.select("path", F.col("bytes").alias("_named"))
    b = listing.select("path", F.col("bytes").alias("_held"))
    status = F.when(F.col("_held").isNull(), "missing").when(F.col("_named").isNull(), "unnamed").when(F.col("_held") != F.col("_named"), "size").otherwise("ok")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def deletable(evidence: DataFrame) -> DataFrame:
    """Whether a local file may go: all four of recorded, listed, same size and chained; else the first reason why not."""
    reason = F.lit(None).cast("string")
    for name in ("chained", "same_size", "listed", "recorded"):
        reason = F.when(~F.coalesce(F.col(name), F.lit(False)), f"not {name}").otherwise(reason)
    return evidence.withColumn("reason", reason).withColumn("clear", F.col("reason").isNull())
