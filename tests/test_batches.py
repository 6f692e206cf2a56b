"""Columns in pieces, and the functions that work on them piece by piece."""

import hashlib

import pyarrow as pa

from gristmill.functions import batches, fingerprint, html, nodes
from gristmill.operators import content
from pyspark.sql import functions as F


def test_pieces_are_small_and_whole():
    texts = ["a" * n if n else None for n in (0, 3, 4, 50, 1, 0, 9, 2)]
    column = pa.array(texts)
    got = list(batches.pieces(column, pa.array(range(8)), most=8))
    assert [t for part, _ in got for t in part] == texts and [i for _, part in got for i in part] == list(range(8))
    assert all(len(part) == 1 or sum(len(t or "") for t in part[1:]) <= 8 for part, _ in got) and len(got) == 3
    assert list(batches.pieces(pa.array([], pa.string()))) == [([],)] and list(batches.pieces(pa.array([None, "é"])))[0] == ([None, "é"],)


def test_a_batch_leaves_in_pieces():
    page = "<title>t</title><p>" + "word " * 60_000
    pages, urls = pa.array([page, None, page, page, page, page]), pa.array(["http://h.org/"] * 6)
    for made in (html._extract([(pages, urls)]), html._titles([(pages, urls)]), nodes._trees([pages])):
        parts = list(made)
        assert len(parts) > 1 and sum(map(len, parts)) == 6


def test_title_is_that_of_extract(spark):
    pages = ["<title>a  b</title>", "<meta name=robots content=noindex><title>x</title>", "<h1>one</h1>", "<meta property='og:title' content='o'>", None, "", "<title>open", "<title></title><h1>two"]
    df = spark.createDataFrame([(p, "http://h.org/") for p in pages], "h string, u string")
    got = df.select(html.title(F.col("h"), F.col("u")).alias("a"), html.extract(F.col("h"), F.col("u"))["title"].alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and got[0]["a"] == "a b"


def test_texts_are_not_shuffled_for_scores(spark, monkeypatch):
    monkeypatch.setattr(content, "ROWS_A_TASK", 5)
    df = spark.createDataFrame([(i, f"<body><div class=nav-x><p>{'long words ' * 9}</p></div></body>") for i in range(6)], "page_id long, html string")
    scores = content.element_scores(content.page_nodes(df))
    assert not {"text", "class", "id"} & set(scores.columns) and scores.where("tag = 'div'").select("marks", "paragraphs").distinct().collect() == [(1, 1)]
    assert scores.rdd.getNumPartitions() == 1 + 6 * 5 // 5


def test_sketches_are_those_of_each_hash_permuted(spark):
    """Texts of many chunks and pieces, blank ones and values at the modulus, against plain integers."""
    texts = [None, "", " \t\n\f\r ", "a", "a  b\tc", " ".join(f"w{i}" for i in range(1500)), "é ü\n" * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: [r[f"m{i}"] for i in range(64)] for r in fingerprint.sketches(df).collect()}
    assert sorted(got) == [3, 4, 5, 6]
    for i, slots in got.items():
        t = texts[i].split()
        hashes = [int(hashlib.md5(" ".join(t[k : k + 5]).encode()).hexdigest()[:16], 16) % fingerprint.PRIME for k in range(max(len(t) - 4, 1))]
        assert slots == [min((a * h + b) % fingerprint.PRIME for h in hashes) for a, b in fingerprint.permutations()]
    parts = list(fingerprint._pieced(len, pa.int64())([pa.array(["x" * 700_000] * 6)]))
    assert len(parts) > 1 and sum(map(len, parts)) == 6
