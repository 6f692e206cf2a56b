"""JSON-LD against a recursive walk."""

import json
import random

from pyspark.sql import functions as F

from gristmill.functions import jsonld


def by_hand(texts):
    out = {"types": [], "published": None, "modified": None, "headline": None, "author": None}
    short = lambda s: " ".join(s.split()).encode()[:128].decode(errors="ignore") if isinstance(s, str) else ""

    def author(v):
        if isinstance(v, list):
            return next((a for a in map(author, v) if a), None)
        if isinstance(v, dict):
            v = v.get("name")
        return short(v) or None

    def walk(v, depth):
        if depth > 8:
            return
        if isinstance(v, list):
            for x in v:
                walk(x, depth + 1)
        elif isinstance(v, dict):
            kinds = v.get("@type")
            for kind in kinds if isinstance(kinds, list) else [kinds]:
                if short(kind) and short(kind) not in out["types"]:
                    out["types"].append(short(kind))
            for slot, key in (("published", "datePublished"), ("modified", "dateModified"), ("headline", "headline")):
                out[slot] = out[slot] or short(v.get(key)) or None
            out["author"] = out["author"] or author(v.get("author"))
            if "@graph" in v:
                walk(v["@graph"], depth + 1)

    for text in texts:
        try:
            walk(json.loads(text), 0)
        except ValueError:
            pass
    return out


def anything(r, depth):
    text = lambda: r.choice(["", " ", "a", " b  c\n", "d", "é" * 90, "x" + "é" * 90, "€" * 120, "\U0001f600" * 90])
    leaf = lambda: r.choice([text(), text(), 3, None, True, [], {}])
    if depth == 0 or r.random() < 0.15:
        return leaf()
    if r.random() < 0.4:
        return [anything(r, depth - 1) for _ in range(r.randint(0, 3))]
    out = {}
    for key in ("@type", "datePublished", "dateModified", "headline", "author"):
        if r.random() < 0.4:
            out[key] = r.choice([leaf, lambda: [leaf(), leaf()], lambda: {"name": leaf()}, lambda: [3, {"name": leaf()}, leaf()]])()
    if r.random() < 0.8:
        out["@graph"] = anything(r, depth - 1)
    return out


def test_walk(spark):
    r = random.Random(5)
    pages = [[], ["{"], ["nope", '{"@type": "A"}'], ["3", "null", '"x"']] + [[json.dumps(anything(r, r.randint(0, 12))) for _ in range(r.randint(1, 3))] for _ in range(500)]
    nested = lambda n: json.dumps({"@type": "deep"}) if n == 0 else f"[{nested(n - 1)}]"
    pages += [[nested(8)], [nested(9)], None]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, t array<string>")
    got = {x["i"]: x["s"].asDict() for x in df.select("i", jsonld.structured(jsonld.objects(F.col("t"))).alias("s")).collect()}
    want = {i: by_hand(p or []) for i, p in enumerate(pages)}
    assert sum(len(w["types"]) > 1 for w in want.values()) > 20 and sum(w["author"] is not None for w in want.values()) > 20
    assert got == want
    assert got[len(pages) - 3]["types"] == ["deep"] and got[len(pages) - 2]["types"] == []


def test_blocks_and_content(spark):
    html = [
        (0, None), (1, ""), (2, "<p>x"), (3, '<script>{"@type":"A"}</script>'),
        (4, '<SCRIPT id=a TYPE=application/ld+json>{"@type":"A","headline":"h"}</SCRIPT><script type="application/ld+json">[{"@type":["B","A"]}]\n</script >'),
        (5, "<script type='application/ld+json'>{\"@type\":\"A\""),
        (6, '<script type=application/ld+json>{"@type":"%s"}</script>' % ("x" * 256 * 1024)),
    ]
    df = spark.createDataFrame(html, "i int, h string").select("i", jsonld.structured(jsonld.objects(jsonld.blocks(F.col("h"))), F.lit(False)).alias("s"))
    got = {x["i"]: x["s"] for x in df.collect()}
    assert {i: s["types"] for i, s in got.items()} == {0: [], 1: [], 2: [], 3: [], 4: ["A", "B"], 5: [], 6: []} and got[4]["headline"] is None
