"""Lloyd clustering of integer vectors with block-norm screening.

A vector is cut into segments; its compressed form is the norm of each segment.
By Cauchy-Schwarz x.c <= sum of |x_s| |c_s|, so the squared distance of x and c is
at least the sum of (|x_s| - |c_s|)^2. Norms are floors of square roots and a gap
of two floors is lowered by one, so the bound is an integer and never too high.
Each vector first meets the centroid of least bound exactly; another one only if
its bound is not above the least distance found so far.

The vectors with their segment norms are written once and read each round where
they lie; a round shuffles ``k`` sums a task. The driver holds ``k`` centroids.

Rules: a vector of another length than ``dims``, or with a null or non-finite
component, is left out, and so is one with a component of 2**27 or more after
scaling, since distances must fit a long. Rows that repeat an id are vectors of
their own. A vector with a null id is clustered, but never a first centroid. With
fewer than ``k`` ids there are as many centroids. An inertia over a long is null.
Ties of the first centroids' hashes (repeated ids) go by the vectors' bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import durable

#: Scaled components stay below this, so that a squared distance of 64 differences is below 2**62.
LIMIT = 1 << 27


def segment_norms(x: np.ndarray, segments: int) -> np.ndarray:
    """Floors of the Euclidean norms of ``segments`` runs of components, one row a vector."""
    squares = np.add.reduceat(x.astype(np.int64) ** 2, np.arange(segments) * x.shape[1] // segments, axis=1)  # none of them is empty
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    return root - (root * root > squares)


def lower_bounds(norms: np.ndarray, centre_norms: np.ndarray) -> np.ndarray:
    """At most the squared distance of each vector (row) and centroid (column)."""
    gap = np.abs(norms[:, None, :].astype(np.int64) - centre_norms[None, :, :]) - 1
    return (np.maximum(gap, 0) ** 2).sum(2)


def nearest(x: np.ndarray, norms: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each vector, the smaller number of equals, and how many exact distances that took."""
    bound = lower_bounds(norms, segment_norms(centres, norms.shape[1]))
    label, least, exact = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max), 0
    first = bound.argmin(1)
    for turn in (True, False):
        for c in range(len(centres)):
            rows = np.flatnonzero(first == c if turn else (first != c) & (bound[:, c] <= least))
            d = ((x[rows].astype(np.int64) - centres[c]) ** 2).sum(1)
            exact += len(rows)
            better = (d < least[rows]) | (d == least[rows]) & (c < label[rows])
            label[rows[better]], least[rows[better]] = c, d[better]
    return label, least, exact


def _scaled(dims: int, scale: int, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pc.fill_null(pc.equal(pc.list_value_length(batch.column("vector")), dims), False)
            batch = batch.filter(whole)
            values = batch.column("vector").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(values * scale)
            good = (np.isfinite(scaled) & (np.abs(scaled) < LIMIT)).all(1)
            x = np.where(good[:, None], scaled, 0).astype(np.int32)[good]
            norms = segment_norms(x, segments).astype(np.int32)
            packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x, norms)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(good)), *packed], ["vec_id", "x", "norms"])

    return run


def _unpacked(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), np.int32).reshape(batch.num_rows, -1)


def _sums(centres: np.ndarray):
    """Per task and centroid with vectors: how many, and the sum of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _unpacked(batch, "x")
                label = nearest(x, _unpacked(batch, "norms"), centres)[0]
                for c in np.unique(label):
                    count[c] += (label == c).sum()
                    total[c] += x[label == c].sum(0, dtype=np.int64)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count[held]), pa.array(total[held].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return run


def _labels(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                label, least, _ = nearest(_unpacked(batch, "x"), _unpacked(batch, "norms"), centres)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(label.astype(np.int32)), pa.array(least)], ["vec_id", "cluster", "distance"])

    return run


def moved(vectors: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of their vectors' means; an empty one stays."""
    sums = vectors.mapInArrow(_sums(centres), "cluster long, n long, total array<long>")
    rows = sums.select("cluster", "n", F.posexplode("total").alias("at", "part")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
    out = centres.copy()
    for r in rows.collect():  # k x dims rows
        out[r["cluster"], r["at"]] = r["total"] // r["n"]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3", segments: int = 16) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid`` a kept vector; ``centroid`` is the final one of its cluster."""
    spark, segments = vectors.sparkSession, min(segments, dims)
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    kept = durable(named.mapInArrow(_scaled(dims, scale, segments), "vec_id long, x binary, norms binary"), "vectors")
    first = kept.where("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "x").limit(k).collect()
    centres = np.array([np.frombuffer(r["x"], np.int32) for r in first], np.int64).reshape(-1, dims)
    if not len(centres):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    for _ in range(rounds):
        centres = moved(kept, centres)
    assigned = durable(kept.mapInArrow(_labels(centres), "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda d: d if d < 1 << 63 else None
    about = [(c, fits(d), fits(sum(inertia.values())), centres[c].tolist()) for c, d in inertia.items()]
    return assigned.join(F.broadcast(spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid array<long>")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
