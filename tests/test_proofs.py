"""Trees and proofs as rows against the tree of one body in memory."""

from gristmill.functions import merkle
from gristmill.operators import proofs
from pyspark.sql import functions as F

SIZES = [0, 1, 15, 16, 17, 32, 33, 48, 80, 16 * 7, 16 * 8, 16 * 9 + 3, 16 * 33]


def test_every_leaf_of_every_body(spark, monkeypatch):
    monkeypatch.setattr(merkle, "CHUNK", 16)
    bodies = {i: "".join(chr(97 + (i * k) % 26) for k in range(n)) for i, n in enumerate(SIZES)} | {99: None}
    leaves = proofs.chunks(spark.createDataFrame(list(bodies.items()), "page_id int, html string"), size=16).withColumn("digest", proofs.leaf_digest(F.col("chunk")))
    levels = proofs.tree_levels(leaves)
    got = {r["page_id"]: bytes(r["root"]) for r in proofs.roots(levels).collect()}
    assert got == {i: merkle.levels(b.encode())[-1][0] for i, b in bodies.items() if b is not None}
    found = proofs.proofs(levels)
    paths = {(r["page_id"], r["leaf"]): [bytes(x) for x in r["path"]] for r in found.collect()}
    want = {(i, k): [x for x in merkle.proof(b.encode(), k) if x is not None] for i, b in bodies.items() if b is not None for k in range(max(1, -(-len(b) // 16)))}
    assert paths == want
    rows = found.join(leaves, ["page_id", "leaf"]).join(proofs.roots(levels), "page_id")
    ok = lambda digest=F.col("digest"), index=F.col("leaf"), count=F.col("width"), path=F.col("path"): F.count_if(proofs.proves(F.col("root"), index, count, digest, path))
    n = len(want)
    one = rows.agg(ok().alias("good"), ok(digest=proofs.leaf_digest(F.concat("chunk", F.lit("x").cast("binary")))).alias("tampered"), ok(path=F.concat("path", F.array("root"))).alias("longer"),
                   ok(index=F.col("width")).alias("outside"), ok(index=F.lit(-1)).alias("negative"), ok(path=F.array().cast("array<binary>")).alias("empty"), ok(index=F.col("leaf").bitwiseXOR(F.lit(1).cast("long"))).alias("moved")).first()
    assert (one["good"], one["tampered"], one["longer"], one["outside"], one["negative"]) == (n, 0, 0, 0, 0)
    assert one["empty"] == sum(not p for p in want.values()) and one["moved"] < n / 4


def test_no_bodies(spark):
    none = proofs.chunks(spark.createDataFrame([(1, None)], "page_id int, html string")).withColumn("digest", proofs.leaf_digest(F.col("chunk")))
    levels = proofs.tree_levels(none)
    assert proofs.proofs(levels).count() == proofs.roots(levels).count() == 0
