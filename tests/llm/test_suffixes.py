"""Byte-level substring deduplication against brute force, and its sort and merge."""

import random

import numpy as np
import pytest
from cases import ODD, corpus
from gristmill.llm import suffix_runs
from gristmill.llm.suffix_dedup import anchors, common_windows, suffix_dedup


def by_hand(rows, size=50):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        for k in range(len(b) - size + 1):
            if i is not None:
                first[b[k : k + size]] = min(i, first.get(b[k : k + size], i))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - size + 1):
            if i is not None and first[b[k : k + size]] < i:
                gone[k : k + size] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def got(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(((*r[:4], bytes(r[4])) for r in suffix_dedup(docs, **more).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    rows = corpus(seed)
    want = by_hand(rows)
    assert sum(w[3] for w in want) > 20
    assert got(spark, rows) == want


def test_many_ranges(spark):
    """Ranges that cut runs of equal suffixes apart."""
    rows = corpus(3, 80)
    assert got(spark, rows, range_keys=40, sampled=2) == by_hand(rows)


@pytest.mark.parametrize("window,base", [(1, 1), (3, 2), (6, 6), (20, 5), (127, 30)])
def test_window_sizes(spark, window, base):
    rows = corpus(4, 30)
    assert got(spark, rows, window=window, base=base) == by_hand(rows, window)


def test_odd_rows(spark, odd, none):
    want = by_hand([(i, t) for i, t, _ in ODD])
    assert sorted(((*r[:4], bytes(r[4])) for r in suffix_dedup(odd).collect()), key=str) == want
    assert suffix_dedup(none).count() == 0
    long, nul = "x" * 70_000, "\0" * 60 + "é" * 40
    rows = [(1, long), (2, long + "y" + long), (2, "é" * 30), (3, nul), (4, "a" + nul), (4, nul + "b"), (None, long), (5, long[:49]), (6, nul[:-1]), (7, "é" * 60), (7, "é" * 60)]
    assert got(spark, rows) == by_hand(rows)


def test_a_passage_of_many_documents(spark):
    """Each has its own neighbours, so the passage's edges make as many classes as documents."""
    r = random.Random(5)
    passage = "".join(r.choice("abcdef ") for _ in range(90))
    rows = [(i, "".join(r.choice("ghijkl") for _ in range(60)) + passage + "".join(r.choice("mnopqr") for _ in range(60))) for i in range(300)]
    assert got(spark, rows) == by_hand(rows)
    assert got(spark, rows, range_keys=100, sampled=8) == by_hand(rows)


def random_runs(seed, k, width, letters=3):
    r = np.random.default_rng(seed)
    runs = []
    for _ in range(k):
        keys = r.integers(0, letters, (r.integers(1, 60), width)).astype(np.uint8)
        order, lcp = suffix_runs.sort_keys(keys)
        new = lcp < width
        new[0] = True
        runs.append((keys[order[new]], lcp[new]))
    return runs


@pytest.mark.parametrize("k", [1, 2, 3, 7, 16])
def test_merge(k):
    for width in (1, 4, 9, 30):
        runs = random_runs(k, k, width)
        run, lcp = suffix_runs.merge(runs)
        want = sorted((row.tobytes(), i) for i, (rows, _) in enumerate(runs) for row in rows)
        at = [iter(rows) for rows, _ in runs]
        merged = [next(at[i]) for i in run]
        assert [(m.tobytes(), i) for m, i in zip(merged, run.tolist())] == want
        assert (lcp == suffix_runs.shared(np.array(merged))).all()


def test_merge_reads_no_known_prefix_again():
    """Runs whose keys share long prefixes: the bytes compared are far fewer than the shared ones."""
    reads = [0]

    class Counted(bytes):
        def __getitem__(self, i):
            out = bytes.__getitem__(self, i)
            if isinstance(i, slice):
                return Counted(out)
            reads[0] += 1
            return out

    class Rows(np.ndarray):
        def tobytes(self, order="C"):
            return Counted(np.ndarray.tobytes(self, order))

    r, width = np.random.default_rng(1), 100
    keys = np.full((400, width), 7, np.uint8)
    keys[:, 80:] = r.integers(0, 2, (400, 20))
    order, lcp = suffix_runs.sort_keys(keys)
    runs = [(np.ascontiguousarray(keys[order[i::8]]).view(Rows), suffix_runs.shared(keys[order[i::8]])) for i in range(8)]
    suffix_runs.merge(runs)
    assert 0 < reads[0] < 400 * 40  # a plain comparison reads the 80 equal bytes of both heads, three matches a key


def test_front_coding():
    for rows, lcp in random_runs(9, 5, 12):
        owner, many = np.arange(len(rows)) * 10**12 - 5, np.arange(len(rows)) % 3 == 0
        back = suffix_runs.unpack(suffix_runs.pack(rows, lcp, owner, many), 12)
        assert all((a == b).all() for a, b in zip((rows, lcp, owner, many), back))


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(2)
    for size, base in ((50, 20), (10, 3), (9, 9), (30, 8)):
        data = r.integers(97, 100, 4000).astype(np.uint8)
        data[1500:1700], data[3000:3200] = 97, data[500:700]
        at = anchors(data, np.array([0, 900, 900, 905, 2500, 4000]), size, base)
        held = {}
        for a, b in ((0, 900), (905, 2500), (2500, 4000)):
            for s in range(a, b - size + 1):
                inside = set((at[(at >= s) & (at <= s + size - base)] - s).tolist())
                assert inside
                held.setdefault(data[s : s + size].tobytes(), []).append(inside)
        assert any(len(x) > 1 for x in held.values())
        assert all(set.intersection(*x) for x in held.values())


def test_common_windows():
    r = random.Random(7)
    window, base = 8, 3
    keys, owners = [], []
    for _ in range(300):
        right, left = ("".join(r.choice("ab") for _ in range(r.choice([3, 6, 8, 8, 8]))), "".join(r.choice("ab") for _ in range(r.choice([0, 2, 5, 5, 5]))))
        keys.append(right.encode().ljust(8, b"\0") + left.encode().ljust(5, b"\0") + bytes([len(right), len(left)]))
    keys = sorted(set(keys))
    owners = [r.randrange(40) for _ in keys]
    rows = np.array([[*k] for k in keys], np.uint8)
    found = common_windows(rows, suffix_runs.shared(rows), np.array(owners), window, base)
    of = lambda k, o: (k[:base], k[8 : 8 + o][::-1] + k[: window - o]) if k[-1] >= o and k[-2] >= window - o else None
    for i, k in enumerate(keys):
        for o in range(6):
            assert found[i, o] == (of(k, o) is not None and any(of(x, o) == of(k, o) and owners[j] < owners[i] for j, x in enumerate(keys)))
