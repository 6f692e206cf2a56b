"""Pairs of 64-bit fingerprints within a few bits, by exact blocks.

Cut 64 bits into ``blocks``; two fingerprints that differ in at most ``distance`` bits agree in all but
``distance`` of them. So they agree in one of the choices of ``blocks - distance`` blocks, and each choice is
an equality join on its bits. With six blocks and a distance of three a key has about 32 bits.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.fingerprint import hamming


def masks(distance: int, blocks: int) -> list[int]:
    """The bits of every choice of blocks, as signed 64-bit integers."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << b - a) - 1) << a for a, b in zip(cuts, cuts[1:])]
    bits = [reduce(int.__or__, chosen) for chosen in combinations(block, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in bits]


def close_pairs(rows: DataFrame, key: str = "doc_id", value: str = "simhash", *, distance: int = 3, blocks: int = 6) -> DataFrame:
    """``a, b, bits, n_a, n_b``: pairs of different fingerprints at most ``distance`` bits apart, each named by the smallest key that has it, with how many do.

    Equal fingerprints are one, so copies are never spread into pairs. A null or zero fingerprint (of no shingles) is like no other.
    A pair comes from the first choice of blocks in which it agrees, so none comes twice.
    """
    if not 0 < distance < blocks <= 64:
        raise ValueError("there must be more blocks than bits of distance")
    chosen = masks(distance, blocks)
    values = rows.where(F.col(value) != 0).groupBy(F.col(value).alias("v")).agg(F.min(key).alias("first"), F.count("*").alias("n"))
    masked = F.array(*[F.struct(F.lit(t).alias("table"), F.col("v").bitwiseAND(F.lit(m)).alias("bits")) for t, m in enumerate(chosen)])
    held = values.select("v", "first", "n", F.explode(masked).alias("k")).select("v", "first", "n", "k.table", F.col("k.bits").alias("at"))
    x, y = held.alias("x"), held.alias("y")
    unlike = F.col("x.v").bitwiseXOR(F.col("y.v"))
    first: Column = F.coalesce(*[F.when(unlike.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(chosen)])
    # A value stands in as many rows as there are choices, which the planner cannot see: it would broadcast them all.
    met = x.join(y.hint("merge"), (F.col("x.table") == F.col("y.table")) & (F.col("x.at") == F.col("y.at")) & (F.col("x.first") < F.col("y.first")))
    near = met.where((hamming(F.col("x.v"), F.col("y.v")) <= distance) & (first == F.col("x.table")))
    return near.select(F.col("x.first").alias("a"), F.col("y.first").alias("b"), hamming(F.col("x.v"), F.col("y.v")).alias("bits"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))
