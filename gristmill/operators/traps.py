"""Crawler traps: path segments that are session identifiers, and prefixes with too many URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.storage import durable

#: A segment looks random from so many characters and bits of entropy a character on.
LEAST_LENGTH, LEAST_BITS = 8, 2.75


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits, rounded to 9 places; 0 for an empty one."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
    return F.round(F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c))), 9)


def looks_random(segment: Column, length: int = LEAST_LENGTH, bits: float = LEAST_BITS) -> Column:
    return (F.char_length(segment) >= length) & (entropy(segment) >= bits)


def wildcard_paths(urls: DataFrame, vary: int = 2) -> DataFrame:
    """``host, path`` and ``pattern`` of each distinct pair: the path with ``*`` for segments that vary.

    A segment varies if it looks random and at least ``vary`` random segments stand
    in its place in paths of the host that are otherwise the same. Each place is
    judged on the paths as given. Distinct values of a place are told apart before
    they are counted, so no task holds all of a host. Null hosts and paths give no row.
    """
    paths = durable(urls.where("host is not null and path is not null").select("host", "path").distinct().withColumn("t", F.split("path", "/")), "paths")
    places = paths.select("host", "path", "t", F.posexplode("t").alias("at", "segment")).where(looks_random(F.col("segment")))
    holed = F.array_join(F.transform("t", lambda s, i: F.when(i == F.col("at"), F.lit("*")).otherwise(s)), "/")
    # The place is told by its number too: a path may hold a star of its own.
    random = durable(places.select("host", "path", "at", F.md5(holed).alias("hole")), "places")
    counted = random.groupBy("host", "at", "hole").agg(F.count("*").alias("n")).where(F.col("n") >= vary)
    holes = random.join(counted.select("host", "at", "hole"), ["host", "at", "hole"], "left_semi").groupBy("host", "path").agg(F.collect_set("at").alias("holes"))
    joined = paths.join(holes, ["host", "path"], "left")
    is_hole = lambda i: F.coalesce(F.array_contains("holes", i), F.lit(False))
    return joined.select("host", "path", F.array_join(F.transform("t", lambda s, i: F.when(is_hole(i), F.lit("*")).otherwise(s)), "/").alias("pattern"))


def prefixes(patterns: DataFrame, budget: int, depth: int = 2) -> DataFrame:
    """``host, prefix, urls, patterns, over``: distinct paths and patterns under the first ``depth`` segments, and whether paths exceed the budget.

    Wildcards stand for all their segments, so a prefix that varies is one prefix.
    """
    prefix = F.substring_index("pattern", "/", depth + 1)
    per = patterns.groupBy("host", prefix.alias("prefix"), "pattern").agg(F.count("*").alias("n"))
    out = per.groupBy("host", "prefix").agg(F.sum("n").alias("urls"), F.count("*").alias("patterns"))
    return out.withColumn("over", F.col("urls") > budget)
