"""Stratified sampling by rank, bounded picks per group, and round-robin trimming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.storage import durable


def global_rank(rows: DataFrame, *order: Column) -> DataFrame:
    """Each row's place (``rank``, from 1) in a total order, without one task that sees all rows.

    Rows are dealt by ranges of the order; a place is the sizes of the ranges
    before, one number a range, plus the place in the range.
    """
    dealt = durable(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before, at = [F.lit(-1), F.lit(0).cast("long")], 0
    for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():
        before += [F.lit(r["_range"]), F.lit(at).cast("long")]
        at += r["n"]
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("rank", place + F.create_map(*before)[F.col("_range")]).drop("_range")


def strata(spark, bounds: list[tuple[str, int, int | None]], last: int) -> DataFrame:
    """``stratum, lo, hi`` of a few ranges; an open end is the population's greatest rank."""
    return spark.createDataFrame([(s, lo, last if hi is None else hi) for s, lo, hi in bounds], "stratum string, lo long, hi long")


def systematic(ranked: DataFrame, strata_: DataFrame, rank: str, per_stratum: int) -> DataFrame:
    """Every so-many-th row of each stratum. The ranges are a handful of literal rows, so the range join broadcasts them."""
    inside = ranked.join(F.broadcast(strata_), (F.col(rank) >= F.col("lo")) & (F.col(rank) <= F.col("hi")))
    step = F.greatest(F.expr(f"(hi - lo + 1) div {per_stratum}"), F.lit(1))
    return inside.where((F.col(rank) - F.col("lo")) % step == 0)


def picks(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group in the given order (a total one), numbered. The limit prunes below the shuffle."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)


def round_robin(picked: DataFrame, stratum: str, order: str, keep: int) -> DataFrame:
    """Of each stratum the first ``keep`` rows, first picks of all groups before second ones."""
    w = Window.partitionBy(stratum).orderBy("pick", order)
    return picked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)
