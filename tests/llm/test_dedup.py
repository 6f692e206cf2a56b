"""Line, substring and near deduplication against brute force."""

import random
import re
import tempfile
from collections import defaultdict

import pytest
from cases import ODD, corpus
from gristmill.llm.line_dedup import apply_line_dedup, line_dedup
from gristmill.llm.near_dedup import apply_near_dedup, near_duplicates
from gristmill.llm.substring_dedup import substring_dedup
from gristmill.operators.graph import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def lines_by_hand(rows, min_docs=3, min_chars=20):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < min_docs or i == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def substrings_by_hand(rows, size=50):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[k : k + size])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def near_by_hand(rows, size=5):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((i, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets]


def order(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rows = corpus(seed)
    got = line_dedup(frame(spark, rows)).collect()
    assert sum(r["n_dropped"] for r in got) > 0
    assert order(got) == order(lines_by_hand(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = corpus(seed)
    got = substring_dedup(frame(spark, rows)).collect()
    assert sum(r["n_removed"] for r in got) > 0
    assert order(got) == order(substrings_by_hand(rows))


@pytest.mark.parametrize("size", [2, 3, 7, 50])
def test_substring_dedup_window_sizes(spark, size):
    rows = corpus(3, 40)
    assert order(substring_dedup(frame(spark, rows), window=size).collect()) == order(substrings_by_hand(rows, size))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = corpus(seed)
    got = near_duplicates(frame(spark, rows)).collect()
    assert sum(not r["kept"] for r in got) > 5
    assert order(got) == order(near_by_hand(rows))


def test_odd_rows(odd):
    rows = [(i, t) for i, t, _ in ODD]
    assert order(line_dedup(odd).collect()) == order(lines_by_hand(rows))
    assert order(substring_dedup(odd).collect()) == order(substrings_by_hand(rows))
    assert order(near_duplicates(odd).collect()) == order(near_by_hand(rows))


def test_repeated_ids_with_other_texts(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (2, "x " + long), (2, long + " y"), (2, long)]
    assert order(substring_dedup(frame(spark, rows)).collect()) == order(substrings_by_hand(rows))


def test_no_rows(none):
    assert line_dedup(none).count() == substring_dedup(none).count() == near_duplicates(none).count() == 0
    assert apply_line_dedup(none).columns == apply_near_dedup(none).columns == none.columns


def test_applied(spark):
    rows = corpus(4)
    docs = frame(spark, rows).selectExpr("doc_id", "text", "length(text) AS n_chars", "'s' AS source")
    want = {i: t for i, _, _, t in lines_by_hand(rows)}
    out = apply_line_dedup(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    kept = {r["doc_id"] for r in apply_near_dedup(docs).collect()}
    assert kept == {i for i, _, _, keep in near_by_hand(rows) if keep}


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}


def test_a_large_group_of_copies(spark):
    rows = [(i, "the same few words in all of them again") for i in range(500)] + [(1000, "other")]
    got = near_duplicates(frame(spark, rows)).collect()
    assert {r["component_id"] for r in got} == {0, 1000}


def test_a_pair_that_no_star_tests(spark):
    """One bucket of a hundred unlike sets with one pair in it, of which neither is the star's centre."""
    from gristmill.operators.overlap import similar_components, stars

    sets = [(i, [1, 2, 3] + [1000 * i + k for k in range(9)]) for i in range(100)] + [(200, [1, 2, 3] + [60_000 + k for k in range(8)])]
    star = stars(spark.createDataFrame([(7, i) for i, _ in sets], "key long, rep long"))
    got = similar_components(star, spark.createDataFrame(sets, "rep long, shingles array<long>"), 75)
    assert {r["node"]: r["comp"] for r in got.collect()} == {60: 60, 200: 60}


@pytest.mark.parametrize("percent", [50, 75, 90])
def test_all_pairs_of_a_bucket_are_settled(spark, percent):
    """Changed copies of one set in a bucket, at similarities on both sides of the threshold to the star's centre and to each other."""
    r = random.Random(percent)
    base = list(range(60))
    sets = {0: base}
    for i in range(1, 90):
        own = list(sets[r.randrange(max(1, i // 2))] if r.random() < 0.5 else base)
        for _ in range(r.randint(1, 30)):
            own[r.randrange(len(own))] = r.choice([r.randrange(10**6), 100 + r.randrange(20)])
        sets[i] = own[: r.randint(40, 60)]
    sets = {i: sorted(set(s)) for i, s in sets.items()}
    comp = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            a, b = set(sets[i]), set(sets[j])
            if 100 * len(a & b) >= percent * len(a | b) and comp[i] != comp[j]:
                low, high = sorted((comp[i], comp[j]))
                comp = {k: low if c == high else c for k, c in comp.items()}
    from gristmill.operators.overlap import similar_components, stars

    star = stars(spark.createDataFrame([(7, i) for i in sets], "key long, rep long"))
    got = similar_components(star, spark.createDataFrame(list(sets.items()), "rep long, shingles array<long>"), percent)
    found = {r["node"]: r["comp"] for r in got.collect()}
    assert {i: found.get(i, i) for i in sets} == comp


def test_near_duplicates_of_each_text_of_a_repeated_id(spark):
    words = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(1, words("a") + " x"), (2, words("a")), (2, words("b")), (3, words("b") + " y"), (4, words("c")), (5, words("c")), (5, words("d"))]
    assert order(near_duplicates(frame(spark, rows)).collect()) == order(near_by_hand(rows))
    assert {r["doc_id"] for r in apply_near_dedup(frame(spark, rows)).collect()} == {1, 4}


def test_names_that_the_stages_use_themselves(spark):
    rows = [(i, "the same line in three documents\nline " + str(i), "a", "b", i) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gm_id string, _gm_text string, _gm_gone int")
    assert {r["text"] for r in apply_line_dedup(docs).collect()} == {"line 0", "line 1", rows[2][1]}
    assert apply_near_dedup(docs).columns == apply_line_dedup(docs).columns == docs.columns


def test_lines_of_repeated_ids_with_other_texts(spark):
    line = "a line that three documents have"
    rows = [(1, line), (2, f"alpha\n{line}"), (2, "beta"), (2, f"{line}\ngamma"), (3, line), (None, line)]
    assert order(line_dedup(frame(spark, rows)).collect()) == order(lines_by_hand(rows))
    assert order((r["doc_id"], r["text"]) for r in apply_line_dedup(frame(spark, rows)).collect()) == order((i, t) for i, _, _, t in lines_by_hand(rows))


def shuffled_bytes(spark, run):
    """The bytes that the shuffles of ``run`` write."""
    from py4j.protocol import Py4JJavaError

    context = spark.sparkContext
    context.setLocalProperty("spark.jobGroup.id", "shuffled")
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker, moved = context.statusTracker(), 0
    for stage in {s for j in tracker.getJobIdsForGroup("shuffled") for s in tracker.getJobInfo(j).stageIds}:
        try:
            moved += context._jsc.sc().statusStore().lastStageAttempt(stage).shuffleWriteBytes()
        except Py4JJavaError:  # a skipped stage, whose output was there already
            continue
    return moved


def test_texts_without_candidates_are_not_shuffled(spark):
    """Where the candidates are too many to be broadcast, only their texts move."""
    r = random.Random(5)
    text = lambda: " ".join(f"{r.getrandbits(40):x}" for _ in range(2000))
    rows = [(i, text()) for i in range(150)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(3)]
    docs = frame(spark, rows).repartition(3)
    docs.write.mode("overwrite").parquet(path := tempfile.mkdtemp(prefix="gristmill-test-") + "/docs")
    before, in_all = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), sum(len(t) for _, t in rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = []
        moved = shuffled_bytes(spark, lambda: out.extend(apply_near_dedup(spark.read.parquet(path)).select("doc_id", "text").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r["doc_id"] for r in out} == set(range(150))
    assert moved < in_all // 2


@pytest.mark.parametrize("most", [1 << 15, 1 << 27])
def test_sieved_joins_are_the_plain_joins(spark, monkeypatch, most):
    """Also where the bitmap is full and where keys are null, are not met or come twice."""
    from gristmill.operators import sieve

    monkeypatch.setattr(sieve, "MOST", most)
    rows = spark.range(60_000).selectExpr("if(id % 1000 = 7, null, id) AS a", "id % 3 AS b", "cast(id AS string) AS c")
    keys = spark.range(0, 180_000, 3).selectExpr("if(id % 1001 = 7, null, id) AS a", "id % 2 AS b").union(spark.sql("SELECT 6L, 0L"))
    for sieved, how in ((sieve.with_key, "left_semi"), (sieve.without_key, "left_anti")):
        got, want = sieved(rows, keys), rows.join(keys, ["a", "b"], how).select("a", "b", "c")
        assert got.columns == rows.columns and want.count() > 9000
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
        assert sieved(rows, keys.limit(0)).count() == (0 if how == "left_semi" else 60_000)
