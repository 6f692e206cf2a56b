"""What a crawl covers: matchers, block lists with parents, owners, corroboration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import urls


def matches(url: Column, kind: str, value: str) -> Column:
    """One matcher: ``pld``, ``host``, ``suffix`` (on a label's border), ``path`` (prefix) or ``regex`` (the whole URL)."""
    host = urls.host(url)
    if kind == "pld":
        return urls.pay_level_domain(host) == value
    if kind == "host":
        return host == value
    if kind == "suffix":
        return (host == value) | host.endswith("." + value)
    if kind == "path":
        return urls.path(url).startswith(value)
    if kind == "regex":
        return url.rlike(f"^(?:{value})$")
    raise ValueError(f"no such matcher: {kind}")


def in_scope(url: Column, include: list[tuple[str, str]], exclude: list[tuple[str, str]]) -> Column:
    """Any include (or none is given), and no exclude."""
    any_of = lambda rules: reduce(Column.__or__, [matches(url, *r) for r in rules], F.lit(False))
    return (any_of(include) if include else F.lit(True)) & ~any_of(exclude)


def blocked_with_parents(pages: DataFrame, host: str, blocks: DataFrame) -> DataFrame:
    """The rows whose host or any parent domain is in ``blocks`` (column ``domain``): an equi-join on exploded parents."""
    hosts = pages.select(host).distinct().withColumn("domain", F.explode(urls.parent_domains(F.col(host))))
    bad = hosts.join(blocks.select("domain").distinct(), "domain", "left_semi").select(host).distinct()
    return pages.join(bad, host, "left_semi")


def owners(domains: DataFrame, key: str, peers: list[str]) -> DataFrame:
    """Each domain's owner by rendezvous hashing: the peer of the greatest hash with it. Peers are a short literal list."""
    scored = F.array(*[F.struct(F.md5(F.concat(F.lit(p + "/"), F.col(key).cast("string"))).alias("h"), F.lit(p).alias("peer")) for p in sorted(peers)])
    return domains.select(key, F.array_max(scored)["peer"].alias("owner"))


def corroborated(held: DataFrame, key: str, source: str, trusted: Column, least: int = 2) -> DataFrame:
    """Keys that a trusted source names, or that many independent ones do: ``key, sources, graduates``."""
    per = held.groupBy(key).agg(F.count_distinct(source).alias("sources"), F.max(trusted.cast("int")).alias("_t"))
    return per.select(key, "sources", ((F.col("_t") == 1) | (F.col("sources") >= least)).alias("graduates"))


def daily_cap(rows: DataFrame, host: str, day: Column, order: list[Column], cap: int) -> DataFrame:
    """At most ``cap`` rows of a host a day, the first in order."""
    w = Window.partitionBy(host, day).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def over_budget_prefixes(pages: DataFrame, url: str, cap: int) -> DataFrame:
    """``host, prefix, urls``: first path segments under which a host has more than ``cap`` distinct URLs."""
    u = F.col(url)
    prefix = F.concat(F.lit("/"), F.get(F.split(urls.path(u), "/"), F.lit(1)))
    return pages.groupBy(urls.host(u).alias("host"), prefix.alias("prefix")).agg(F.count_distinct(u).alias("urls")).where(F.col("urls") > cap)
