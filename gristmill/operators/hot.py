"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot that holds more than one in so many rows, so there are fewer hot keys than this.
PARTS = 1000


def join_by_share(rows: DataFrame, found: DataFrame, keys: list[str], held: str = "n", rows_in_all: int | None = None) -> DataFrame:
    """``rows`` inner joined to ``found``, which has one row a key and in ``held`` the rows that have the key, or less.

    Keys that hold more than one in PARTS of all rows meet their rows where these
    lie, by a broadcast of fewer than PARTS rows; the others are shuffled. So no
    task reads a key's rows alone, whatever the key's share. Both inputs are read
    more than once and should be written tables.
    """
    least = (rows.count() if rows_in_all is None else rows_in_all) // PARTS
    if (found.agg(F.max(held)).first()[0] or 0) <= least:
        return rows.join(found, keys)
    hot = F.broadcast(found.where(F.col(held) > least))
    cold = found.where(F.col(held) <= least)
    columns = [*rows.columns, *(c for c in found.columns if c not in keys)]
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).select(*columns).union(rest.join(cold, keys).select(*columns))
