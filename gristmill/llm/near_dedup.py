"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates, exact confirmation.

1. One pass over the texts gives each document's shingle count, a 128-bit
   digest of its shingle set and the bucket keys of its sketch's bands.
2. Documents with equal sets form a class, of which the smallest doc_id goes on,
   so thousands of copies cost one row each.
3. Representatives that share a bucket are candidates. A bucket of m members
   gives m - 1 edges, from the member that meets most others over all its
   buckets to the rest; edges that several bands give are one. No bucket is cut.
4. The edges' documents' full sets are joined to them and links confirmed by
   exact intersection. Only their texts are shuffled: a bitmap of them leaves the
   others where they lie (``operators.sieve``).
5. What the stars leave open, members of a bucket in different components, is
   settled by an exact filter over their differences from the star's centre
   (``operators.overlap``). So every pair that shares a bucket is linked, or in
   one component, or shown to be unlike, at far fewer rows than pairs.

With 32 bands of 4 of 128 bins a pair at similarity 0.75 shares no bucket with
probability (1 - 0.75**4)**32, about 5e-6, and about ten buckets on average.

Rules: null and empty texts have no shingles and are linked with nothing. Rows
with a null doc_id are returned with a null component and are kept. Rows that
repeat a doc_id are one node, which has the links of each of their texts. The
smallest doc_id of a component is kept, so there are no ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import words as W
from gristmill.llm.common import carried, durable, fresh_worker, restored
from gristmill.llm.shingles import band_keys, shingle_sets, sketches
from gristmill.operators.overlap import similar_components, stars
from gristmill.operators.sieve import with_key, without_key

FEATURES = "doc_id long, version long, n long, d1 long, d2 long, bands array<long>"


def features_of(size: int, bins: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            for part, sets in shingle_sets(batch, "text", size):
                keys = W.signed(band_keys(sketches(sets, bins), bands))
                some = np.array([len(s) > 0 for s in sets])
                offsets = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("version"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(W.signed(np.array([W.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64))),
                        pa.array(W.signed(np.array([W.mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64) for s in sets], np.uint64))),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(keys[some]).ravel())),
                    ],
                    ["doc_id", "version", "n", "d1", "d2", "bands"],
                )

    return run


def sets_of(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            for part, sets in shingle_sets(batch, "text", size):
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("version"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(W.signed(np.concatenate(sets))))], ["doc_id", "version", "shingles"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 75, bins: int = 128, bands: int = 32) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    features = durable(texts.mapInArrow(features_of(shingle, bins, bands), FEATURES), "features")
    rep = F.struct("doc_id", "version").alias("rep")
    classes = durable(features.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min(rep).alias("rep")), "classes")
    one = features.withColumn("rep", rep).join(classes, ["d1", "d2", "n", "rep"], "left_semi").dropDuplicates(["rep"])
    star = durable(stars(one.select("rep", F.explode("bands").alias("key"))), "stars")
    wanted = durable(star.select(F.explode(F.array("hub", "rep")).alias("rep")).distinct().select("rep.*"), "wanted")
    sets = with_key(texts, wanted).dropDuplicates(["doc_id", "version"]).mapInArrow(sets_of(shingle), "doc_id long, version long, shingles array<long>")
    named = durable(features.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2", "n"], "left").select("doc_id", "n", F.col("rep.doc_id").alias("node")), "named")
    # A repeated id stands for the classes of all its texts.
    several = named.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u < v").select("doc_id", "u")
    same_id = named.join(several, "doc_id").where("u < node").select("u", F.col("node").alias("v")).distinct()
    comps = similar_components(star, durable(sets.select(rep, "shingles"), "sets"), percent, lambda rep: rep["doc_id"], same_id)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "node", "doc_id"))
    placed = named.join(comps.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return placed.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def apply_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The documents without those that a smaller doc_id of their component stands for; all columns stay."""
    gone = durable(near_duplicates(docs, id_col, text_col, **parameters).where("not kept").select(F.col("doc_id").alias("_gm_gone")).distinct(), "gone")
    rows = docs.select(*carried(docs), F.col(f"`{id_col}`").cast("long").alias("_gm_gone"))
    return restored(without_key(rows, gone), docs)
