"""Mirrors, near duplicates and soft 404 hosts against brute force."""

import random
from itertools import combinations

import pytest

from gristmill.functions.fingerprint import sketches
from gristmill.operators import clusters


def test_mirrors_that_share_without_the_smallest_host(spark):
    held = {"a": ["p0"], "b": [f"p{i}" for i in range(10)], "c": [f"p{i}" for i in range(10)], "d": ["p1", "q1", "q2", "q3"], "e": ["r"]}
    docs = spark.createDataFrame([(h, t) for h, texts in held.items() for t in texts], "source string, text string")
    want = set()
    for x, y in combinations(sorted(held), 2):
        common, smaller = len(set(held[x]) & set(held[y])), min(len(held[x]), len(held[y]))
        if common and common >= 0.8 * smaller:
            want.add((x, y, common, smaller))
    assert ("b", "c", 10, 10) in want
    assert set(map(tuple, clusters.host_pairs(docs).collect())) == want


def similar(a: str, b: str) -> bool:
    x, y = [{tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in (a.split(), b.split())]
    return 100 * len(x & y) >= 75 * len(x | y)


def classes_by_hand(texts: dict[int, str]) -> dict[int, int]:
    comp = {i: i for i in texts}
    for i, j in combinations(sorted(texts), 2):
        if comp[i] != comp[j] and similar(texts[i], texts[j]):
            low, high = sorted((comp[i], comp[j]))
            comp = {k: low if c == high else c for k, c in comp.items()}
    return comp


def near_texts() -> dict[int, str]:
    """Unlike texts with a common opening, copies, and changed copies around the threshold; short texts."""
    r = random.Random(5)
    words = lambda k: [f"w{r.randrange(5000)}" for _ in range(k)]
    opening, texts = words(30), []
    for _ in range(40):
        base = opening + words(r.choice([20, 60, 90]))
        texts.append(base)
        for changes in r.sample([0, 1, 1, 2, 2, 3], 2):
            changed = list(base)
            for _ in range(changes):
                changed[r.randrange(len(changed))] = f"x{r.randrange(10**6)}"
            texts.append(changed)
    out = [" ".join(t) for t in texts] + ["not found", "not  found ", "gone", ""]
    r.shuffle(out)
    return dict(enumerate(out))


def test_near_classes_are_those_of_all_pairs(spark):
    texts = near_texts()
    want = classes_by_hand(texts)
    assert 20 < len(set(want.values())) < len(texts) - 20
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = clusters.near_clusters(docs).collect()
    assert len(got) == len(texts) and {r["doc_id"]: r["cluster"] for r in got} == want


def test_candidates_are_all_pairs_of_a_bucket(spark):
    texts = near_texts() | {1000 + i: " ".join(f"c{k}" for k in range(40)) for i in range(4)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    slots = {r["doc_id"]: [r[f"m{i}"] for i in range(64)] for r in sketches(docs).collect()}
    reps = {}
    for i in sorted(slots):
        reps.setdefault(tuple(slots[i]), i)
    want = set()
    for a, b in combinations(sorted(reps.values()), 2):
        same = [x == y for x, y in zip(slots[a], slots[b])]
        if any(all(same[k : k + 8]) for k in range(0, 64, 8)):
            want.add((a, b, sum(same)))
    pairs, members = clusters.near_candidates(docs)
    got, of = [tuple(r) for r in pairs.collect()], {r["doc_id"]: r["rep"] for r in members.collect()}
    assert want and len(got) == len(want) and set(got) == want
    assert of == {i: reps[tuple(s)] for i, s in slots.items()} and of[1003] == of[1001] == 1000


def test_pairs_of_different_texts_and_copies(spark):
    """Texts that differ and have one sketch are a pair; a copy is met once, by the first that has its text."""
    word = [f"r{k % 3}" for k in range(40)]
    texts = near_texts() | {2000: " ".join(word), 2001: " ".join(word + word[1:3] + word[:1]), 2002: " ".join(word)} | {3000 + i: "c  d" if i else "c d" for i in range(5)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    slots = {r["doc_id"]: [r[f"m{i}"] for i in range(64)] for r in sketches(docs).collect()}
    first = {}
    for i in sorted(slots):
        first.setdefault(" ".join(texts[i].split()), i)
    want = {(first[" ".join(texts[i].split())], i, 64) for i in slots} - {(i, i, 64) for i in slots}
    for a, b in combinations(sorted(first.values()), 2):
        same = [x == y for x, y in zip(slots[a], slots[b])]
        if any(all(same[k : k + 8]) for k in range(0, 64, 8)):
            want.add((a, b, sum(same)))
    assert {(2000, 2001, 64), (2000, 2002, 64), (3000, 3004, 64)} <= want and (2001, 2002, 64) not in want
    got = [tuple(r) for r in clusters.near_pairs(docs).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("most", [0, 1000])
def test_shared_shingles(spark, most):
    words = [f"w{i}" for i in range(30)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:7])), (3, "w0 w1 w2"), (4, None), (5, ""), (6, " ".join(words[:7] * 3))]
    items = [("a", " ".join(words[:8])), ("b", " ".join(words[20:])), ("c", "w0 w1 w2"), ("d", None), ("b", " ".join(words[20:]))]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = {tuple(r) for r in clusters.shared_shingles(*frames, 3, most).collect()}
    assert got == {(1, "a", 4), (1, "b", 6), (2, "a", 3), (6, "a", 3)}
    assert (3, "c", 1) in {tuple(r) for r in clusters.shared_shingles(*frames, 1, most).collect()}


def test_error_pages_that_differ_in_a_word(spark):
    page = " ".join(f"e{k}" for k in range(60))
    rows = [(i, "s", f"{page} /path{i}") for i in range(7)] + [(10 + i, "s", f"own text {i} of this page {i}") for i in range(3)] + [(20 + i, "t", f"another text {i} of page {i}") for i in range(4)]
    got = clusters.top_share(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert {tuple(r) for r in got} == {("s", 10, 7, True), ("t", 4, 1, False)}


def test_heads_lose_no_similar_pair_and_leave_out_unlike_texts(spark):
    """Every set with a partner is promising, at the threshold too; sets that share a fifth are not."""
    from pyspark.sql import functions as F

    from gristmill.operators.overlap import head_size, promising

    r, sets = random.Random(9), {}
    passage = [r.getrandbits(62) for _ in range(40)]
    for _ in range(60):
        n = r.choice([1, 2, 3, 4, 7, 8, 20, 100, 300])
        base = [r.getrandbits(62) for _ in range(n)]
        off = n // 4 if r.random() < 0.6 else n // 4 + 1
        # A part of the first set, or as many elements exchanged as the threshold allows, or one more.
        other = base[off:] if r.random() < 0.5 else base[n // 7 + (off > n // 4) :] + [r.getrandbits(62) for _ in range(n // 7)]
        for s in (base, other):
            sets[len(sets)] = set(s) or {r.getrandbits(62)}
    alike = {i for a, b in combinations(sets, 2) for i in (a, b) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    unlike = set(range(1000, 1020))
    sets |= {i: {*passage, *(r.getrandbits(62) for _ in range(400))} for i in unlike}
    df = spark.createDataFrame([(i, list(s)) for i, s in sets.items()], "rep long, s array<long>").withColumn("n", F.size("s"))
    heads = df.select("rep", "n", F.slice(F.sort_array("s"), F.lit(1), F.expr(head_size(75))).alias("head"))
    got = {row["rep"] for row in promising(heads, 75).collect()}
    assert 40 < len(alike) < 120 and alike <= got and not got & unlike


def test_repeated_keys_with_common_ones(spark):
    """A key that most rows have is found without a shuffle, and ranks after all others."""
    from gristmill.operators.overlap import repeated

    rows = [(i, k) for i in range(3000) for k in (1, 10_000 + i, 20_000 + i // 2)]
    got = {(x["rep"], x["key"]): x["often"] for x in repeated(spark.createDataFrame(rows, "rep long, key long")).collect()}
    assert set(got) == {(i, k) for i, k in rows if k == 1 or k >= 20_000}
    assert all(got[i, 1] > 3000 and got[i, 20_000 + i // 2] == 2 for i in range(3000))
