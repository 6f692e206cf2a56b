"""Hash trees over the chunks of bodies as rows, with inclusion proofs; a body need not fit a row of nodes, nor its tree a task.

A leaf is the SHA-256 of 0x00 and the chunk, an inner node that of 0x01 and its two children; an odd last node
goes up as it is. A level is made from the one below by a grouping on the parent's number, so a tree of n
leaves takes log2(n) rounds over halving rows, and paths come back down by as many joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.merkle import CHUNK
from gristmill.storage import durable


def leaf_digest(chunk: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit("00")), chunk), 256))


def node_digest(left: Column, right: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit("01")), left, right), 256))


def chunks(bodies: DataFrame, key: str = "page_id", body: str = "html", size: int = CHUNK) -> DataFrame:
    """``key, leaf, chunk`` of every body's UTF-8 bytes; an empty body has one empty chunk, a null one none."""
    data = bodies.where(F.col(body).isNotNull()).select(key, F.encode(body, "UTF-8").alias("_b"))
    at = F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("_b") / size).cast("int") - 1, F.lit(0)))
    return data.select(key, "_b", F.explode(at).alias("leaf")).select(key, F.col("leaf").cast("long").alias("leaf"), F.substring("_b", F.col("leaf") * size + 1, F.lit(size)).alias("chunk"))


def tree_levels(leaves: DataFrame, key: str = "page_id") -> list[DataFrame]:
    """``key, at, digest, width`` of each level, the leaves (``key, leaf, digest``) first; the last has every key's root. Written tables."""
    counts = leaves.groupBy(key).agg(F.count("*").alias("width"))
    out = [durable(leaves.select(key, F.col("leaf").alias("at"), "digest").join(counts, key), "leaves")]
    while not out[-1].where("width > 1").isEmpty():
        side = lambda n: F.max(F.when(F.col("at") % 2 == n, F.col("digest")))
        pairs = out[-1].groupBy(key, F.floor(F.col("at") / 2).alias("at")).agg(side(0).alias("_l"), side(1).alias("_r"), F.first("width").alias("_w"))
        up = pairs.select(key, "at", F.when(F.col("_r").isNull(), F.col("_l")).otherwise(node_digest(F.col("_l"), F.col("_r"))).alias("digest"), F.ceil(F.col("_w") / 2).cast("long").alias("width"))
        out.append(durable(up, "level"))
    return out


def roots(levels: list[DataFrame], key: str = "page_id") -> DataFrame:
    return levels[-1].select(key, F.col("digest").alias("root"))


def proofs(levels: list[DataFrame], key: str = "page_id") -> DataFrame:
    """``key, leaf, width, path`` of every leaf: the neighbours from the leaf up, none where a node goes up alone."""
    down = levels[-1].select(key, F.col("at"), F.array().cast("array<binary>").alias("path"))
    for level in reversed(levels[:-1]):
        above = down.select(key, F.col("at").alias("_up"), "path")
        other = level.select(key, (F.col("at").bitwiseXOR(F.lit(1).cast("long"))).alias("at"), F.col("digest").alias("_other"))
        rows = level.where("width > 1").select(key, "at", F.floor(F.col("at") / 2).alias("_up")).join(other, [key, "at"], "left").join(above, [key, "_up"])
        beside = F.when(F.col("_other").isNull(), F.col("path")).otherwise(F.concat(F.array("_other"), "path"))
        # Keys whose tree ends at this level or below are at their root already.
        ended = level.where("width = 1").select(key, "at", F.array().cast("array<binary>").alias("path"))
        down = rows.select(key, "at", beside.alias("path")).unionByName(ended)
    return down.select(key, F.col("at").alias("leaf"), "path").join(levels[0].select(key, F.col("at").alias("leaf"), "width"), [key, "leaf"])


def proves(root: Column, index: Column, count: Column, digest: Column, path: Column) -> Column:
    """Whether the path leads from the leaf's digest to the root, with none of it left over. All that is needed is in the row."""
    # Lambdas see only what is bound here: a name in them would be looked up among the aliases of the select around.
    given = F.struct(root.alias("root"), index.cast("long").alias("at"), count.cast("long").alias("width"), digest.alias("have"), path.alias("path"))
    held = lambda v: (v["at"] >= 0) & (v["at"] < v["width"]) & F.coalesce(_climbs(v), F.lit(False))
    return F.element_at(F.transform(F.array(given), held), 1)


def _climbs(v: Column) -> Column:
    height = F.when(v["width"] > 1, F.ceil(F.log2(v["width"].cast("double"))).cast("int")).otherwise(0)
    steps = F.when(height > 0, F.sequence(F.lit(1), height + 1)).otherwise(F.array().cast("array<int>"))  # one more, in case a logarithm is rounded down
    start = F.struct(v["at"].alias("at"), v["width"].alias("width"), v["have"].alias("have"), F.lit(0).alias("used"))

    def climb(s: Column, _: Column) -> Column:
        done, alone = s["width"] <= 1, (s["at"] == s["width"] - 1) & (s["width"] % 2 == 1)
        beside = F.get(v["path"], s["used"])
        have = F.when(s["at"] % 2 == 0, node_digest(s["have"], beside)).otherwise(node_digest(beside, s["have"]))
        return F.struct(
            F.when(done, s["at"]).otherwise(F.floor(s["at"] / 2)).alias("at"), F.when(done, s["width"]).otherwise(F.ceil(s["width"] / 2).cast("long")).alias("width"),
            F.when(done | alone, s["have"]).otherwise(have).alias("have"), (s["used"] + F.when(done | alone, 0).otherwise(1)).alias("used"),
        )

    return F.aggregate(steps, start, climb, lambda s: (s["have"] == v["root"]) & (s["used"] == F.size(v["path"])))
