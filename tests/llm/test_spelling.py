"""Spelling variants against all pairs of words by hand."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from cases import ODD
from gristmill.llm.spelling_variants import one_edit, variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2}
    others = {w: [v for v in n if abs(len(v) - len(w)) < 2 and near(w, v)] for w in n}
    form = {}
    for w, vs in others.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(others[w]), n.get(form[w])))
    return sorted(out, key=str)


def altered(r, word):
    at, x = r.randrange(len(word)), r.choice("abcé")
    return r.choice([word[:at] + word[at + 1 :], word[:at] + x + word[at:], word[:at] + x + word[at + 1 :]])


def texts(seed):
    r = random.Random(seed)
    common = ["".join(r.choice("abcé") for _ in range(r.randint(7, 19))) for _ in range(9)]
    rare = [altered(r, w) for w in common for _ in range(5)]
    words = common * 330 + rare * 26 + [altered(r, w) for w in rare] * 2
    r.shuffle(words)
    return [(i, r.choice([" ", ", ", "-"]).join(x if r.random() < 0.9 else x.upper() for x in words[k : k + 40])) for i, k in enumerate(range(0, len(words), 40))]


def got(spark, rows, **more):
    return sorted(map(tuple, variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **more).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_variants(spark, seed):
    rows = texts(seed)
    want = by_hand(rows)
    assert sum(w[1] is not None for w in want) > 20 and sum(w[2] != (w[1] or w[0]) for w in want) > 0
    assert got(spark, rows) == want


def test_halves_that_many_words_share(spark):
    """Every segment is hot: blocks of pairs, none lost and none twice."""
    rows = [(i, f"{p}{a}{b}{c} " * 2) for i, (p, a, b, c) in enumerate(itertools.product(["abcabca", "bcabcab"], "ab", "abc", "ab"))]
    assert got(spark, rows, hot=3) == by_hand(rows)
    rows = texts(3)
    assert got(spark, rows, hot=2) == by_hand(rows)


def test_odd_rows(spark, odd, none):
    assert sorted(map(tuple, variants(odd).collect()), key=str) == by_hand([(i, t) for i, t, _ in ODD])
    assert variants(none).count() == 0
    long = "abcdefg" * 3000
    rows = [(1, f"{long} {long}x {long}"), (1, f"{long}x"), (2, None), (3, "ÀÉÎÕÜß ÀÉÎÕÜßÿ àÉÎÕÜßÿ " * 2), (4, "abcdef ABCDEFG abcdefgh abcdefgh"), (4, "ABCDEFG"), (None, "abcdefg"), (5, "repeated repeated")]
    assert got(spark, rows) == by_hand(rows)


def test_names_that_clash(spark):
    rows = texts(4)
    docs = spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in rows], "doc_id long, text string, n int, word string, side string, parts int")
    assert sorted(map(tuple, variants(docs).collect()), key=str) == by_hand(rows)


def test_one_edit_of_all_short_strings():
    every = ["".join(x) for n in range(5) for x in itertools.product("ab", repeat=n)]
    every += [x * 9 for x in every]
    h, k = one_edit([x.encode() for x in every], [x.encode() for x in every])
    assert sorted(zip(h.tolist(), k.tolist())) == [(i, j) for i, a in enumerate(every) for j, b in enumerate(every) if a != b and near(a, b)]
