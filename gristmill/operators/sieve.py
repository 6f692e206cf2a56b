"""Joins of wide rows to the keys of few of them: a bitmap of the keys' hashes first tells most of the others, where they lie.

A plain semi or anti join shuffles all rows, texts included, as soon as the keys
are too many to be broadcast. Here the bitmap is broadcast, which has BITS bits a
key and MOST in all, so only rows that it does not rule out are shuffled, about
one in BITS of those without a key. The join itself decides. With far more keys
than MOST bits hold, the bitmap rules out little and the join is the plain one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap for each key, and in all (16 MiB).
BITS, MOST = 16, 1 << 27
#: Bits of one of Spark's bitmaps.
_BUCKET = 1 << 15


def _marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``_may``: false only where no row of the written table ``keys`` has the values of its columns, which have the same types in both."""
    bits = min(MOST, _BUCKET * (1 + keys.count() * BITS // _BUCKET))
    at: Column = F.pmod(F.xxhash64(*keys.columns), F.lit(bits)) + 1
    maps = keys.select(at.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_map"))
    may = F.expr("coalesce(shiftrightunsigned(cast(conv(hex(substring(_map, cast(_bit div 8 + 1 as int), 1)), 16, 10) as int), cast(_bit % 8 as int)) & 1, 0) = 1")
    placed = rows.withColumn("_bucket", F.bitmap_bucket_number(at)).withColumn("_bit", F.bitmap_bit_position(at))
    return placed.join(F.broadcast(maps), "_bucket", "left").withColumn("_may", may).drop("_bucket", "_bit", "_map")


def with_key(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose values of the columns of ``keys``, a written table, are in it (a left semi join)."""
    return _marked(rows, keys).where("_may").drop("_may").join(keys, keys.columns, "left_semi").select(*rows.columns)


def without_key(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose values of the columns of ``keys``, a written table, are not in it (a left anti join). ``rows`` is read twice."""
    marked = _marked(rows, keys)
    rest = marked.where("_may").drop("_may").join(keys, keys.columns, "left_anti").select(*rows.columns)
    return marked.where("not _may").drop("_may").select(*rows.columns).union(rest)
