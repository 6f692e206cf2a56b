"""Centroid clustering against the rule by hand."""

import hashlib
import math
import random

import numpy as np
from gristmill.llm.centroid_clustering import cluster, lower_bounds, nearest, segment_norms


def by_hand(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    pick = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(rounds):
        own = [[] for _ in centres]
        for _, v in kept:
            own[pick(v)].append(v)
        centres = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c for vs, c in zip(own, centres)]
    out = [(i, pick(v), far(v, centres[pick(v)])) for i, v in kept]
    inertia = {}
    for _, c, d in out:
        inertia[c] = inertia.get(c, 0) + d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), centres[c]) for i, c, d in out), key=str)


def check(spark, rows, **more):
    got = cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), **more)
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows, **more)


def vectors(seed, n, dims=64):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.3) for _ in range(dims)] for _ in range(5)]
    return [(i, [float(np.float32(x + r.gauss(0, 0.1))) for x in r.choice(centres)]) for i in range(n)]


def test_clusters(spark):
    check(spark, vectors(1, 150))
    check(spark, vectors(2, 40, 7), k=3, rounds=4, dims=7)


def test_odd_vectors(spark):
    rows = vectors(3, 30)
    same = rows[4][1]
    check(spark, [*rows, (4, same), (100, same), (101, same), (None, rows[7][1]), (102, None), (103, []), (104, [1.0] * 63), (105, [None, *same[1:]]), (106, [float("nan"), *same[1:]]), (107, [float("inf"), *same[1:]]), (108, [0.0] * 64)])


def test_few_equal_and_no_vectors(spark):
    check(spark, [(i, [0.25] * 64) for i in range(12)])
    check(spark, vectors(4, 3))
    check(spark, [])
    out = spark.createDataFrame([(1, [3e38] * 64), (2, [0.5] * 64)], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["distance"]) for r in cluster(out).collect()] == [(2, 0)]


def test_names_that_clash(spark):
    rows = vectors(5, 20)
    docs = spark.createDataFrame([(i, v, 0, b"x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster int, x binary, norms int")
    assert sorted(map(tuple, cluster(docs).collect()), key=str) == by_hand(rows)


def test_bounds_hold_and_spare_work():
    r = np.random.default_rng(6)
    x = (r.normal(0, 1, (400, 64)) * 10 ** r.uniform(0, 6, (400, 1))).astype(np.int32)
    norms, centres = segment_norms(x, 16), x[:8].astype(np.int64)
    exact = ((x[:, None, :].astype(np.int64) - centres[None]) ** 2).sum(2)
    assert (lower_bounds(norms, segment_norms(centres, 16)) <= exact).all()
    label, least, distances = nearest(x, norms, centres)
    assert (label == exact.argmin(1)).all() and (least == exact.min(1)).all()
    assert distances < exact.size / 2
