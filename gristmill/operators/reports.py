"""Corpus reports: coverage, staleness, mixes, health, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(rows: DataFrame, *keys: str, fetched: Column, at: str, limit: int) -> DataFrame:
    """Per key: urls, fetched ones, the newest; the largest first."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("urls"), F.count_if(fetched).alias("fetched"), F.max(at).alias("newest_ms"))
    return out.orderBy(F.desc("urls"), *keys).limit(limit)


def coverage_rollup(rows: DataFrame, outer: str, inner: str, fetched: Column) -> DataFrame:
    """Coverage per inner key, per outer key and in all; ``level`` counts the keys rolled up."""
    return rows.rollup(outer, inner).agg(F.count("*").alias("urls"), F.count_if(fetched).alias("fetched"), F.grouping_id().cast("long").alias("level"))


def staleness_histogram(rows: DataFrame, at: str, now_ms: int, width_ms: int, *keys: str) -> DataFrame:
    bucket = F.floor((F.lit(now_ms) - F.col(at)) / F.lit(width_ms)).cast("long")
    return rows.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def mix(rows: DataFrame, key: str, condition: Column, least: int, limit: int) -> DataFrame:
    """Per key with more than ``least`` rows: rows and the share for which the condition holds, the greatest share first."""
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(condition.cast("int")), 6).alias("share")).where(F.col("n") > least)
    return out.orderBy(F.desc("share"), key).limit(limit)


def spread(rows: DataFrame, value: str, budget: float, *keys: str) -> DataFrame:
    """n, least, quartiles, 90th percentile, most and the share within a budget; percentiles are exact, between neighbours by interpolation."""
    at = lambda p, name: F.round(F.percentile(value, F.lit(p)), 6).alias(name)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(value).alias("least"), at(0.25, "p25"), at(0.5, "median"), at(0.75, "p75"), at(0.9, "p90"),
        F.max(value).alias("most"), F.round(F.avg((F.col(value) <= budget).cast("int")), 6).alias("within"),
    )


def reasons(rows: DataFrame, ordered: dict[str, Column]) -> DataFrame:
    """Rows by the first reason that holds, ``accepted`` where none does."""
    reason = F.lit("accepted")
    for name, holds in reversed(ordered.items()):
        reason = F.when(holds, name).otherwise(reason)
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def cumulative_buckets(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """A histogram as counts at or under each bound: one pass, a count a bound."""
    counts = rows.agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])
    return counts.select(F.inline(pairs))


#: Verification levels by code (fixed values); any other code, or none, is unverified.
LEVELS = ((0, "local"), (1, "quorum"), (2, "replayed"))


def verification_tally(rows: DataFrame, level: Column, *keys: str) -> DataFrame:
    """Per key: rows at each level of verification."""
    known = F.coalesce(level.isin(*[code for code, _ in LEVELS]), F.lit(False))
    return rows.groupBy(*keys).agg(*[F.count_if(level == code).alias(name) for code, name in LEVELS], F.count_if(~known).alias("unverified"))


def deepest_tiers(rows: DataFrame, key: str, delivered: Column, tier: Column) -> DataFrame:
    """``deepest, domains, urls``: the keys by the deepest tier that delivered (0: none did), and the urls on them."""
    each = rows.groupBy(key).agg(F.coalesce(F.max(F.when(delivered, tier)), F.lit(0)).alias("deepest"), F.count("*").alias("n"))
    return each.groupBy("deepest").agg(F.count("*").alias("domains"), F.sum("n").alias("urls"))
