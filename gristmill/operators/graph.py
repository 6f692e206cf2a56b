"""Connected components of a link table, by joins and grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.storage import durable

#: Rows of a link or label table that a task writes.
ROWS_A_TASK = 100_000


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for every node of the undirected links ``u, v``: comp is the smallest node reachable.

    Each round takes the least label among a node and its neighbours, then the
    label of that label (pointer jumping), so rounds grow with the logarithm of
    the longest path. Labels only fall, so an unchanged sum ends the rounds.
    """
    links = durable(links.select("u", "v"), "edges")
    tasks = 1 + links.count() // ROWS_A_TASK
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    written = lambda t: durable(t.coalesce(tasks), "labels")  # noqa: E731  as many tasks as the number of links asks for
    labels = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("comp")))
    total = lambda t: t.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
    before = total(labels)
    while True:
        heard = both.join(labels, both.v == labels.node).select(F.col("u").alias("node"), "comp")
        nearest = heard.union(labels).groupBy("node").agg(F.min("comp").alias("comp"))
        label_of = labels.select(F.col("node").alias("_at"), F.col("comp").alias("_next"))
        labels = written(nearest.join(label_of, nearest.comp == F.col("_at"), "left").select("node", F.least("comp", F.coalesce("_next", "comp")).alias("comp")))
        after = total(labels)
        if after == before:
            return labels
        before = after
