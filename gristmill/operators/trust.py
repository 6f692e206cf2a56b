"""Reputation, replay rates, alarms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def affine_fold(rows: DataFrame, key: str, chunk: Column, order: list[str], scale: Column, shift: Column, start: float) -> DataFrame:
    """``key, value`` after all steps x -> scale * x + shift in order. Such steps compose, so chunks of time are folded first, in parallel."""
    events = rows.select(key, chunk.alias("_chunk"), F.struct(*order, scale.cast("double").alias("_a"), shift.cast("double").alias("_b")).alias("_e"))
    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    step = lambda s, e: F.struct((s["a"] * e["_a"]).alias("a"), (s["b"] * e["_a"] + e["_b"]).alias("b"))
    chunks = events.groupBy(key, "_chunk").agg(F.aggregate(F.array_sort(F.collect_list("_e")), one, step).alias("_g"))
    apply = lambda x, c: x * c["_g"]["a"] + c["_g"]["b"]
    return chunks.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("_chunk", "_g"))), F.lit(float(start)), apply).alias("value"))


def reputation(rows: DataFrame, key: str, chunk: Column, order: list[str], verdict: Column, start: float = 0.5) -> DataFrame:
    """A pass gains 2 percent of what is missing, a soft failure costs 10 percent, a hard one half."""
    scale = F.when(verdict == "pass", 0.98).when(verdict == "soft", 0.9).when(verdict == "hard", 0.5).otherwise(1.0)
    return affine_fold(rows, key, chunk, order, scale, F.when(verdict == "pass", 0.02).otherwise(0.0), start)


def doubled(rows: DataFrame, key: str, week: str, value: str, least: int) -> DataFrame:
    """Weeks in which a key's count at least doubled on the week before, from a floor on."""
    before = F.lag(F.struct(week, value)).over(Window.partitionBy(key).orderBy(week))
    out = rows.withColumn("_b", before).where((F.col(f"_b.{week}") == F.col(week) - 1) & (F.col(value) >= least) & (F.col(value) >= 2 * F.col(f"_b.{value}")))
    return out.select(key, week, F.col(f"_b.{value}").alias("before"), value)


def replayed(key: Column, probability: Column) -> Column:
    """Whether a row is drawn for replay: its hash as a fraction is under the probability, so a row is always judged alike."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("double") / 4294967296.0 < probability


def quorum_size(rank: Column, is_seed: Column, top: int = 100_000) -> Column:
    """Independent fetches that a URL needs: three for seeds, two for the highest ranks, else one."""
    return F.when(is_seed, 3).when(rank <= top, 2).otherwise(1)


def quorum(rows: DataFrame, key: str, digest: str, network: str, size: Column) -> DataFrame:
    """``key, networks, verdict``: ``replay`` where digests differ, ``quorum`` where enough networks agree, else ``waiting``.

    ``size`` must be the same in all rows of a key. Distinct networks are counted in two steps, so a hot key is summed before it moves.
    """
    seen = rows.groupBy(key, network).agg(F.min(digest).alias("_lo"), F.max(digest).alias("_hi"), F.max(size).alias("_size"))
    per = seen.groupBy(key).agg(F.count(network).alias("networks"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_size").alias("_size"))
    verdict = F.when(F.col("_lo") != F.col("_hi"), "replay").when(F.col("networks") >= F.col("_size"), "quorum").otherwise("waiting")
    return per.select(key, "networks", verdict.alias("verdict"))
