"""Trap patterns against a rule by hand."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gristmill.operators import traps


def bits(s):
    return round(-sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()), 9)


def patterns_by_hand(rows):
    rows = {(h, p) for h, p in rows if h is not None and p is not None}
    seen, loud = defaultdict(set), lambda s: len(s) >= 8 and bits(s) >= 2.75
    for h, p in rows:
        t = p.split("/")
        for i, s in enumerate(t):
            if loud(s):
                seen[h, i, tuple(t[:i]), tuple(t[i + 1 :])].add(s)
    out = {}
    for h, p in rows:
        t = p.split("/")
        out[h, p] = "/".join("*" if loud(s) and len(seen[h, i, tuple(t[:i]), tuple(t[i + 1 :])]) >= 2 else s for i, s in enumerate(t))
    return out


def test_patterns_and_prefixes(spark):
    r = random.Random(3)
    ids = ["".join(r.choice("0123456789abcdef") for _ in range(16)) for _ in range(30)] + ["aaaaaaaaaaaa", "short1", "", "*"]
    rows = [(r.choice("ab"), "/" + "/".join(r.choice(ids + ["shop", "cart", "item"]) for _ in range(r.randint(0, 3)))) for _ in range(400)]
    rows += [(h, f"/s/{i}/cart") for h in "ab" for i in ids[:20]] + [("c", f"/{ids[0]}/x"), (None, "/x"), ("a", None), ("c", "")] + rows[:5]
    df = spark.createDataFrame(rows, "host string, path string")
    made = traps.wildcard_paths(df)
    got = made.collect()
    want = patterns_by_hand(rows)
    assert len(got) == len(want) and {(x["host"], x["path"]): x["pattern"] for x in got} == want
    assert want["a", f"/s/{ids[0]}/cart"] == "/s/*/cart" and want["c", f"/{ids[0]}/x"] == f"/{ids[0]}/x"
    urls, kinds = Counter(), defaultdict(set)
    for (h, _), pattern in want.items():
        key = h, "/".join(pattern.split("/")[:3])
        urls[key] += 1
        kinds[key].add(pattern)
    report = {(x["host"], x["prefix"]): (x["urls"], x["patterns"], x["over"]) for x in traps.prefixes(made, 10).collect()}
    assert report == {k: (n, len(kinds[k]), n > 10) for k, n in urls.items()} and report["a", "/s/*"][2]


def test_entropy(spark):
    texts = ["", "a", "aaaa", "abab", "abcd", "0f3a9b22c1d4e877", "é€é€"]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", traps.entropy(F.col("x")).alias("e"))
    assert all(abs(x["e"] - bits(x["x"])) < 1e-8 for x in df.collect())
    assert traps.wildcard_paths(spark.createDataFrame([], "host string, path string")).count() == 0
