"""Simhashes and close pairs against brute force."""

import hashlib
import random
from itertools import combinations

import pytest
from gristmill.functions import fingerprint
from gristmill.operators.hamming import close_pairs, masks


def by_hand(text):
    t = (text or "").split()
    hashes = [int(hashlib.md5(" ".join(t[i : i + 5]).encode()).hexdigest()[:16], 16) for i in range(len(t) - 4)]
    out = sum(1 << bit for bit in range(64) if sum(2 * (h >> bit & 1) - 1 for h in hashes) > 0)
    return out - (1 << 64) if out >> 63 else out


def test_simhash(spark):
    r = random.Random(1)
    texts = [None, "", "a b c d", "a b c d e", " a  b\tc d e f ", "x " * 300] + [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(3, 200))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {x["doc_id"]: x["simhash"] for x in fingerprint.simhashes(df).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(texts)} and got[0] == got[2] == 0


@pytest.mark.parametrize("distance,blocks", [(1, 2), (2, 4), (3, 4), (3, 6), (5, 8)])
def test_close_pairs(spark, distance, blocks):
    r, values = random.Random(distance), [0, 0, None, -1, -1, 1 << 62]
    for _ in range(60):
        v = r.getrandbits(64)
        for _ in range(4):
            flipped = v
            for bit in r.sample(range(64), r.randint(0, distance + 1)):
                flipped ^= 1 << bit
            values.append(flipped - (1 << 64) if flipped >> 63 else flipped)
    rows = list(enumerate(values))
    first, n = {}, {}
    for i, v in rows:
        if v:
            first.setdefault(v, i)
            n[v] = n.get(v, 0) + 1
    apart = lambda x, y: bin((x ^ y) & (1 << 64) - 1).count("1")
    want = {(first[x], first[y], apart(x, y), n[x], n[y]) for x, y in combinations(sorted(first, key=first.get), 2) if apart(x, y) <= distance}
    got = [tuple(x) for x in close_pairs(spark.createDataFrame(rows, "doc_id int, simhash long"), distance=distance, blocks=blocks).collect()]
    assert len(want) > 30 and len(got) == len(want) and set(got) == want


def test_choices_of_blocks():
    assert len(masks(3, 6)) == 20 and all(30 <= bin(m & (1 << 64) - 1).count("1") <= 34 for m in masks(3, 6))


def test_close_pairs_are_not_broadcast(spark, tmp_path):
    """The values of a small table, once a choice of blocks, do not fit the driver's memory."""
    spark.range(3000).selectExpr("id as doc_id", "xxhash64(id div 2) + id % 2 as simhash").write.parquet(str(tmp_path / "t"))
    pairs = close_pairs(spark.read.parquet(str(tmp_path / "t")))
    assert pairs.count() > 0 and "BroadcastExchange" not in pairs._jdf.queryExecution().executedPlan().toString()
